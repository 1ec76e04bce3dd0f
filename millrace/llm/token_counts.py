"""Token counts by byte-pair merging with a heap and a linked list, without making identifiers.

A word starts as its characters, chained by a linked list. A heap holds the adjacent pairs that some
merge rule joins, by rank and place. The pair of lowest rank is popped again and again, joined in the
list, and its new neighbours are pushed. Each merge removes one symbol, so a word's count is its
number of initial symbols less its merges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.memo import Memo
from millrace.llm.vocabulary import broadcast_file, once_per_worker


def merge_ranks(model: dict) -> dict[tuple[str, str], int]:
    rules = model["merges"]
    pairs = (r.split(" ") if isinstance(r, str) else r for r in rules)
    return {(a, b): i for i, (a, b) in enumerate(pairs)}


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left of ``symbols`` after all merges."""
    n = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        joined = symbols[i] = left + right
        symbols[j] = ""
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            rank = ranks.get((joined, symbols[k]))
            if rank is not None:
                heappush(heap, (rank, i, joined, symbols[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((symbols[h], joined))
            if rank is not None:
                heappush(heap, (rank, h, symbols[h], joined))
    return n - merges


class WordCounter:
    """Token counts of strings without plain spaces, by the vocabulary's own splitting into words."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        described = json.loads(model)
        self.ranks = merge_ranks(described["model"])
        self.vocabulary = described["model"]["vocab"]
        self.ending = described["model"].get("end_of_word_suffix") or ""
        special = [t["content"] for t in described["added_tokens"]]
        longest_first = sorted(special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if special else None
        self.memo = Memo(self, limit=400_000)

    def __call__(self, strings: list[str]) -> list[int]:
        return [self.count(s) for s in strings]

    def count(self, string: str) -> int:
        if string.isascii() and string.isalpha():
            return self._word(string.lower())
        return self._outside(string)

    def _outside(self, string: str) -> int:
        """Each special string counts as one token; what lies between is counted by itself."""
        between = self.special.split(string) if self.special else [string]
        return len(between) - 1 + sum(map(self._plain, between))

    def _plain(self, string: str) -> int:
        if not string:
            return 0
        if self.tokenizer.normalizer:
            string = self.tokenizer.normalizer.normalize_str(string)
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(string)
        return sum(self._word(w) for w, _ in words)

    def _word(self, word: str) -> int:
        if not word:
            return 0
        symbols = [*word[:-1], word[-1] + self.ending]
        if any(s not in self.vocabulary for s in symbols):  # unknown symbols are left out
            symbols = [s for s in symbols if s in self.vocabulary]
        return merged_count(symbols, self.ranks)


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    text_col: str = "text",
    limit: int = 2048,
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    ``vocabulary`` is a BPE file of the ``tokenizers`` library whose splitter drops white space. A
    null or empty text has 0 bytes and 0 tokens. Special strings inside texts count as one token each.
    Columns named like the results are replaced; every row is counted by itself, repeated or not.
    """
    model = broadcast_file(docs.sparkSession, vocabulary)

    def count_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = once_per_worker(model, WordCounter).memo
        for batch in batches:
            words = ((t.as_py() or "").replace("\n", " ").split(" ") for t in batch)
            yield pa.array([sum(memo.many(w)) for w in words], pa.int64())

    udf = F.arrow_udf(count_batches, T.LongType())
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns(
        {"n_bytes": F.octet_length(text).cast("long"), "n_tokens": udf(F.col(text_col))}
    ).withColumn("over_limit", F.col("n_tokens") > limit)
