"""Byte-level BPE: texts to token ids by forced-boundary splitting, and ids back to texts.

No merge can produce a token that holds a pair of neighbouring bytes which no vocabulary token holds.
So such a pair marks a certain cut, and the fragments between cuts may be encoded independently. The
table of the 65,536 pairs comes from the vocabulary; the cuts of a text are one table look-up per
byte. Most cuts fall at word ends, hence the fragments repeat and their ids are remembered.

The library first splits a text by a pattern. A cut never disturbs that splitting if the byte before it
is a printable ASCII character other than the apostrophe (so no white space, whose runs the pattern
looks ahead from) and the byte after it is no apostrophe (with which contractions begin). Only
such cuts are used; all others would be certain, too, but only inside a word of the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.memo import Memo
from millrace.llm.vocabulary import ChunkEncoder, broadcast_file, byte_alphabet, once_per_worker

#: Bytes of texts whose ids are handed on together; a longer text is handed on alone.
OUT_BYTES = 4 << 20


def token_bytes(model: str) -> dict[int, bytes]:
    """Id to bytes for every token; special tokens stand for their own text."""
    from tokenizers import Tokenizer

    tokenizer, alphabet = Tokenizer.from_str(model), byte_alphabet()
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    table = {}
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        if i in special or any(c not in alphabet for c in token):
            table[i] = token.encode()
        else:
            table[i] = bytes(map(alphabet.__getitem__, token))
    return table


def cut_table(tokens: dict[int, bytes]):
    """65,536 flags, at 256 x first byte + second byte: a usable certain cut."""
    import numpy as np

    cuts = np.ones((256, 256), bool)
    for token in tokens.values():
        pair = np.frombuffer(token, np.uint8)
        cuts[pair[:-1], pair[1:]] = False
    usable = np.zeros(256, bool)
    usable[0x21:0x7F] = True
    usable[0x27] = False
    cuts[~usable] = False
    cuts[:, 0x27] = False
    return cuts.reshape(-1)


def fragments(data: bytes, cuts) -> list[str]:
    """``data`` at its certain cuts; every cut follows an ASCII character, so no character is cut."""
    import numpy as np

    if not data:
        return []
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(cuts[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1
    text = data.decode()
    if len(text) != len(data):  # offsets in characters: bytes that begin one
        at = np.cumsum((b & 0xC0) != 0x80)[at - 1]
    ends = at.tolist()
    return [text[i:j] for i, j in zip([0, *ends], [*ends, None], strict=True)]


class FragmentEncoder(ChunkEncoder):
    """Little-endian 32-bit ids of whole texts, from remembered fragments.

    Most fragments are one word of the library's pattern, letters with at most a space before them. Where
    the vocabulary neither normalises such a word nor splits it, its merging is all that is needed.
    """

    #: Letters below U+0180, which every version of Unicode calls letters.
    WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ſ]+")

    def __init__(self, model: str):
        super().__init__(model)
        self.cuts = cut_table(token_bytes(model))
        self.memo = Memo(self)
        self.direct = self.tokenizer.normalizer is None and all(map(self._whole, (" aÀſ", "Zé")))

    def _whole(self, word: str) -> bool:
        written = "".join(map(self.letter.__getitem__, word.encode()))
        splitter = self.tokenizer.pre_tokenizer
        return splitter is not None and [w for w, _ in splitter.pre_tokenize_str(word)] == [written]

    def text(self, data: bytes) -> bytes:
        return b"".join(self.memo.many(fragments(data, self.cuts)))

    def __call__(self, strings: list[str]) -> list[bytes]:
        words = [self.direct and self.WORD.fullmatch(s) is not None for s in strings]
        others = iter(super().__call__([s for s, w in zip(strings, words, strict=True) if not w]))
        return [self.merged(s) if w else next(others) for s, w in zip(strings, words, strict=True)]


def bytes_by_id(model: str) -> list[bytes]:
    table = token_bytes(model)
    return [table.get(i, b"") for i in range(max(table) + 1)]


def encode(
    docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids"
) -> DataFrame:
    """``docs`` with ``ids_col``, the token ids of the whole text.

    ``vocabulary`` is a byte-level BPE file of the ``tokenizers`` library. A null or empty text has
    no ids. Special strings inside texts become special tokens, as the library's default has it. A
    column named like the result is replaced; every row is treated by itself.
    """
    model = broadcast_file(docs.sparkSession, vocabulary)

    def encode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        encoder = once_per_worker(model, FragmentEncoder)

        def array(parts: list[bytes]) -> pa.Array:
            ends = np.cumsum([0, *map(len, parts)]) // 4
            values = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

        for batch in batches:
            parts, held = [], 0
            for text in batch:
                data = (text.as_py() or "").encode()
                parts.append(encoder.text(data))
                held += len(data)
                if held >= OUT_BYTES:
                    yield array(parts)
                    parts, held = [], 0
            if parts:
                yield array(parts)

    udf = F.arrow_udf(encode_batches, T.ArrayType(T.IntegerType()))
    return docs.withColumn(ids_col, udf(F.col(text_col)))


def decode(
    encoded: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded"
) -> DataFrame:
    """``encoded`` with ``text_col``, the text its ids stand for, special tokens included.

    Null ids give a null text, no ids an empty one; an id outside the vocabulary, or null, stands for
    nothing, as in the library. Bytes that are no UTF-8 become replacement characters. A column
    named like the result is replaced.
    """
    model = broadcast_file(encoded.sparkSession, vocabulary)

    def decode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = once_per_worker(model, bytes_by_id)
        for batch in batches:
            values = batch.values.fill_null(-1).to_numpy()  # one text's ids at a time become objects
            ends, out, held = batch.offsets.to_pylist(), [], 0
            for valid, i, j in zip(batch.is_valid().to_pylist(), ends, ends[1:], strict=False):
                part = values[i:j]
                if j > i and (part.min() < 0 or part.max() >= len(known)):
                    part = part[(part >= 0) & (part < len(known))]
                data = b"".join(map(known.__getitem__, part.tolist()))
                out.append(data.decode("utf-8", "replace") if valid else None)
                held += len(data)
                if held >= OUT_BYTES:
                    yield pa.array(out, pa.string())
                    out, held = [], 0
            if out:
                yield pa.array(out, pa.string())

    udf = F.arrow_udf(decode_batches, T.StringType())
    return encoded.withColumn(text_col, udf(F.col(ids_col)))
