"""Byte-pair vocabularies in the JSON format of the ``tokenizers`` library.

The file's text is read once on the driver and broadcast (some megabytes, whatever the corpus), so
executors need no copy of the file.
"""

from __future__ import annotations

import array
import re
from collections.abc import Callable
from typing import TypeVar

from pyspark import Broadcast
from pyspark.sql import SparkSession

from millrace.llm.memo import Memo

T = TypeVar("T")

#: Strings that one call of the library encodes; it holds some hundred bytes for every token of a call.
JOINED = 4096


def broadcast_file(spark: SparkSession, path: str) -> Broadcast:
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def once_per_worker(model: Broadcast, make: Callable[[str], T]) -> T:
    """What ``make`` builds from the broadcast file, built by a Python worker's first task only.

    Spark keeps a broadcast's object in a worker from task to task, so what is built rests there with all
    that it remembers; a new worker builds its own.
    """
    built = vars(model)
    if make.__qualname__ not in built:
        built[make.__qualname__] = make(model.value)
    return built[make.__qualname__]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ChunkEncoder:
    """Ids of many short strings in one call of the library, each as if it were a text of its own.

    The strings are joined by a special token of the vocabulary. The library cuts a text at special
    tokens before it normalises or splits anything, so it sees each string by itself. A string that
    contains a special token is encoded alone.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = list(special)
        self.letter = {b: c for c, b in byte_alphabet().items()}
        self.mark, self.mark_id = next(iter(special.items()), (None, None))

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def merged(self, word: str) -> bytes:
        """The ids of what is one word to the library's splitter, by its merging alone; byte-level vocabularies only."""
        if word.isascii():
            letters = word.replace(" ", self.letter[0x20])
        else:
            letters = "".join(map(self.letter.__getitem__, word.encode()))
        return _packed([token.id for token in self.tokenizer.model.tokenize(letters)])

    def __call__(self, strings: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each string."""
        plain, alone = [], {}
        for i, s in enumerate(strings):
            if self.mark is None or any(t in s for t in self.special):
                alone[i] = _packed(self.ids(s))
            else:
                plain.append(s)
        out = []
        for at in range(0, len(plain), JOINED):
            out += _split(self.ids(self.mark.join(plain[at : at + JOINED])), self.mark_id)
        for i, ids in alone.items():
            out.insert(i, ids)
        return out


class WordEncoder(ChunkEncoder):
    """The same for byte-level vocabularies in lower case that split letters from punctuation.

    Many strings are a word and a full stop or comma, in some case. Of those whose letters are all
    Latin (below U+0180, where lower-casing is the same everywhere and normalising changes nothing),
    the word in lower case and the punctuation are remembered apart. Such a word is all that the
    library's merging needs, so it is handed to that directly. A dotted capital I lower-cases to a
    letter and a combining mark, which the library joins with what follows: it goes to the library.
    """

    #: ASCII punctuation, without the apostrophe, between a letter of Latin-1 and the end of a word.
    CLOSING = re.compile(r"[!-&(-/:-@[-`{-~](?<=[a-zß-öø-ÿ].)[!-&(-/:-@[-`{-~]*(?= |\Z)")

    def __init__(self, model: str, limit: int = 250_000):
        super().__init__(model)
        self.parts = Memo(self._encoded, limit)
        self.strings = Memo(self, limit)
        self.lowered = [t.lower() for t in self.special]

    def text(self, text: str) -> bytes:
        """Ids of a whole text.

        One of Latin-1 letters only, which each lower-case by themselves and are in normal form, is put in
        lower case and parted at once; in any other, and where lower-casing would make a special string,
        each string between spaces is looked at by itself.
        """
        text = text.replace("\n", " ")
        low = text.lower()
        if _is_latin_1(text) and not any(t in low for t in self.lowered):
            return b"".join(self.parts.many(self.CLOSING.sub(r" \g<0>", low).split(" ")))
        return b"".join(self.strings.many(text.split(" ")))

    def __call__(self, strings: list[str]) -> list[bytes]:
        parts, ends = [], []
        for s in strings:
            word = s.rstrip(".,")
            if word.isalpha() and (word.isascii() or _is_latin(word)):
                parts += (word.lower(), s[len(word) :])
            else:
                parts.append(s)
            ends.append(len(parts))
        found, start, out = self.parts.many(parts), 0, []
        for end in ends:
            out.append(found[start] if end - start == 1 else found[start] + found[start + 1])
            start = end
        return out

    def _encoded(self, parts: list[str]) -> list[bytes]:
        simple = [p.islower() and p.isalpha() and (p.isascii() or _is_latin(p)) for p in parts]
        others = iter(super().__call__([p for p, s in zip(parts, simple, strict=True) if not s]))
        return [self.merged(p) if s else next(others) for p, s in zip(parts, simple, strict=True)]


def _is_latin(word: str) -> bool:
    """For letters: whether all are below U+0180, and none is the dotted capital I."""
    return max(word) < "\u0180" and "\u0130" not in word


def _is_latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _packed(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


def _split(ids: list[int], mark: int) -> list[bytes]:
    out, start = [], 0
    ids.append(mark)
    find, last = ids.index, len(ids)
    while start < last:
        end = find(mark, start)
        out.append(_packed(ids[start:end]))
        start = end + 1
    return out
