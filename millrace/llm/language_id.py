"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent n-grams of one to three letters, in order of frequency. A
document's own profile is made from its whole text in the same way; the distance to a language is the
sum, over the document's n-grams, of how far out of place each is in the language's profile, and an
n-gram missing there costs the full profile length. The nearest language wins.

N-grams are whole numbers (21 bits a character, word boundaries as a character of their own), counted
by sorting. The profiles, some hundred numbers per language, are all that is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.columns import as_row, computed_once, of_row

UNKNOWN = "und"
#: N-grams in a profile, and documents per language, on average, from which one is learned.
PROFILE, SAMPLE = 300, 4000
BOUNDARY = 1


class Letters:
    """Codes of a text's lower-cased letters, runs of anything else as one boundary."""

    def __init__(self):
        import numpy as np

        self.known = np.fromiter((chr(c).isalpha() for c in range(0x3000)), bool, 0x3000)

    def __call__(self, text: str):
        import numpy as np

        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = self.known[np.minimum(codes, 0x2FFF)]
        far = codes >= 0x3000
        if far.any():
            kinds, which = np.unique(codes[far], return_inverse=True)
            letter[far] = np.array([chr(c).isalpha() for c in kinds.tolist()])[which]
        if not letter.any():
            return None
        before = np.empty(len(codes), bool)
        before[0] = False
        before[1:] = letter[:-1]
        kept = np.where(letter, codes, BOUNDARY)[letter | before].astype(np.int64)
        edge = np.array([BOUNDARY], np.int64)
        return np.concatenate((edge, kept) if kept[-1] == BOUNDARY else (edge, kept, edge))


def ngrams(codes):
    """All n-grams of one to three characters that hold a letter and no boundary within."""
    import numpy as np

    one = codes[codes != BOUNDARY]
    a, b = codes[:-1], codes[1:]
    two = (a << 21) | b
    inner = codes[1:-1] != BOUNDARY
    three = ((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[inner]
    return np.concatenate((one, two, three))


def most_frequent(grams, n: int):
    """The ``n`` most frequent, ties in order of the n-gram."""
    import numpy as np

    distinct, counts = np.unique(grams, return_counts=True)
    if len(distinct) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        chosen = counts >= least
        distinct, counts = distinct[chosen], counts[chosen]
    return distinct[np.argsort(-counts, kind="stable")][:n]


def learn(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    key_col: str = "doc_id",
    sample: int = SAMPLE,
    profile: int = PROFILE,
) -> dict[str, list[int]]:
    """Each language's most frequent n-grams, in order, from rows with a language and a text.

    About ``sample`` rows per language are used, chosen by a hash of ``key_col``; rows without
    text, language or key are not. N-grams are counted in the tasks; the driver gets ``profile``
    numbers per language.
    """
    rows = labelled.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key_col).alias("draw"),
        F.col(key_col).isNotNull().alias("keyed"),
    ).filter("lang IS NOT NULL AND text IS NOT NULL AND keyed")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    limits = [
        (F.col("lang") == lang) & (F.pmod("draw", F.lit(1 << 30)) < int((1 << 30) * sample / n))
        for lang, n in sizes.items()
        if n > sample
    ]
    whole = F.col("lang").isin([lang for lang, n in sizes.items() if n <= sample])
    drawn = rows.filter(_any([whole, *limits])).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        letters = Letters()
        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, text in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                codes = letters(text)
                if codes is not None:
                    by_lang.setdefault(lang, []).append(np.unique(ngrams(codes), return_counts=True))
            for lang, parts in by_lang.items():
                grams, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(which, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"]
                )

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (
        drawn.mapInArrow(count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= profile)
        .collect()
    )
    profiles: dict[str, list[int]] = {}
    for row in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def predict(
    docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", profile: int = PROFILE
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: 1 less the distance in parts of the largest possible.

    A null text, one without letters, or no profile at all gives ``und`` and 0. Languages at equal
    distance are taken in alphabetical order. Every row is judged by itself, by its whole text and
    nothing else. Columns named like the results are replaced.
    """

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        letters, tables = Letters(), []
        for lang in sorted(profiles):
            grams = np.array(profiles[lang], np.int64)
            order = np.argsort(grams)
            tables.append((lang, grams[order], order))

        def nearest(text: str | None) -> tuple[str, float]:
            codes = letters(text) if text and tables else None
            if codes is None:
                return UNKNOWN, 0.0
            own = most_frequent(ngrams(codes), profile)
            places, distances = np.arange(len(own)), []
            for _, grams, order in tables:
                at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                off = np.where(grams[at] == own, np.abs(order[at] - places), profile)
                distances.append(int(np.minimum(off, profile).sum()))
            best = int(np.argmin(distances))
            return tables[best][0], 1.0 - distances[best] / (profile * len(own))

        for batch in batches:
            found = [nearest(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["lang", "score"],
            )

    judged = F.arrow_udf(judge, "struct<lang:string,score:double>")(F.col(text_col))
    others = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.select(as_row(others), computed_once(judged).alias("judged")).select(
        *of_row(others), F.col("judged.lang").alias("lang_pred"), F.col("judged.score").alias("score")
    )
