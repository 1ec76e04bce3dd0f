"""Quality rules: one table of thresholds, compiled into one projection of Spark expressions.

The measures (counts of words, characters, lines, repeated words) are array expressions over the whole
text; no user function runs and nothing is shuffled. A rule is a row of a table: a share or a mean of
two measures and the least and most it may be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import WORD_GAP, as_row, computed_once, of_row, text_or_empty

SYMBOLS, PUNCTUATION, GAPS = "#*$%&|<>", ".,;:!?", " \t\n\x0b\x0c\r"

#: Frequent function words of the supported languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it with as was on are by be at from this or an".split(),
    "fr": "le la les de des du et un une en que qui dans pour par sur au est avec pas il".split(),
    "de": "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch".split(),
    "es": "el la los las de del y en un una que por con para es se lo su al no como más".split(),
}

#: Rules by name: measure, measure it is divided by, least and most allowed value (None: no limit).
#: The numbers are those of published rule sets for web text, or looser.
RULES: dict[str, tuple[str, str, float | None, float | None]] = {
    "word_length": ("word_chars", "n_words", 2.0, 15.0),
    "symbols": ("n_symbols", "n_words", None, 0.1),
    "shouting": ("n_exclaimed", "n_words", None, 0.3),
    "stop_words": ("n_stop_words", "n_words", 0.02, None),
    "letters": ("n_lettered", "n_words", 0.7, None),
    "dup_lines": ("n_dup_lines", "n_lines", None, 0.5),
    "bullets": ("n_bullets", "n_lines", None, 0.9),
    "ellipses": ("n_ellipses", "n_lines", None, 0.3),
}

#: The base filter: least words, and most words in repeated windows per hundred words.
MIN_WORDS, MAX_REPEATED = 50, 50


def _count(array: Column) -> Column:
    return F.size(array).cast("long")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")).cast("long")


def _has_word(line: Column) -> Column:
    return F.translate(line, GAPS, "") != ""


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``measured`` of counts over the whole text; a null text has nothing.

    Words are separated by ASCII white space, lines by line feeds; a line counts if it holds a word.
    ``n_repeat_words`` counts the words within 3-word windows that occur twice or more. The arrays
    live within the row: a projection each, since Spark keeps apart what is used more than once. An
    existing column ``measured`` is replaced; all others may have any name.
    """
    text, w, line = F.col("text"), F.col("words"), F.col("lines")
    windows = F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    stop = sorted({word for words in STOP_WORDS.values() for word in words})

    def words_that(test) -> Column:
        return _count(F.filter(w, test))

    def lines_that(pattern: str) -> Column:
        return _count(F.filter(line, lambda x: x.rlike(pattern)))

    others = [c for c in docs.columns if c.lower() != "measured"]
    arrays = (
        docs.select(as_row(others), text_or_empty(F.col(text_col)).alias("text"))
        .withColumn("words", F.filter(F.split(text, WORD_GAP), lambda x: x != ""))
        .withColumn("lines", F.filter(F.split(text, "\n"), _has_word))
        .withColumn("windows", windows)
        .withColumn("starts", _repeated_starts(F.col("windows")))
    )
    counts = F.struct(
        _count(w).alias("n_words"),
        _without(text, GAPS).alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).alias("n_symbols"),
        (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"),
        _covered(F.col("starts")).alias("n_repeat_words"),
        _count(line).alias("n_lines"),
        words_that(lambda x: x.endswith("!")).alias("n_exclaimed"),
        words_that(lambda x: F.rtrim(F.lower(x), F.lit(PUNCTUATION)).isin(stop)).alias("n_stop_words"),
        words_that(lambda x: x.rlike(r"\p{L}")).alias("n_lettered"),
        lines_that(r"^\s*[-*•]").alias("n_bullets"),
        lines_that(r"(\.\.\.|…)\s*$").alias("n_ellipses"),
    )
    return arrays.select("row", computed_once(counts).alias("measured")).select(*of_row(others), "measured")


def _repeated_starts(windows: Column) -> Column:
    """Places, in order, of the windows whose 64-bit hash occurs twice or more.

    Hash and place are sorted together; a window is repeated if a neighbour has its hash. Texts in
    which all windows differ need no sorting.
    """
    hash_first = F.transform(windows, lambda g, i: F.struct(g.alias("hash"), i.alias("at")))
    in_order = F.sort_array(hash_first)

    def same(place, x, k):
        return F.coalesce(F.get(place, k)["hash"] == x["hash"], F.lit(False))

    def repeated(place: Column) -> Column:
        twice = F.filter(place, lambda x, k: same(place, x, k - 1) | same(place, x, k + 1))
        return F.sort_array(F.transform(twice, lambda x: x["at"]))

    distinct = F.size(F.array_distinct(windows)) == F.size(windows)
    # transform over a one-element array names the sorted array, so that it is made once
    starts = F.flatten(F.transform(F.array(in_order), repeated))
    return F.when(distinct, F.array().cast("array<int>")).otherwise(starts)


def _covered(starts: Column) -> Column:
    """Words under 3-word windows at these places: three each, or as many as lie before the next."""
    own = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
    return F.aggregate(own, F.lit(0).cast("long"), lambda total, n: total + n)


def compiled(rules: dict = RULES) -> dict[str, Column]:
    """A condition per rule over ``measured``: true where the rule is broken; nothing over nothing is 0."""
    conditions = {}
    for name, (measure, base, least, most) in rules.items():
        share = F.col(f"measured.{measure}") / F.greatest(F.col(f"measured.{base}"), F.lit(1))
        limits = [share < least] * (least is not None) + [share > most] * (most is not None)
        conditions[name] = reduce(Column.__or__, limits, F.lit(False))
    return conditions


def apply_rules(docs: DataFrame, text_col: str = "text", rules: dict = RULES) -> DataFrame:
    """``docs`` with the struct ``measured``, ``broken`` (names of the rules broken), ``base_failed``
    (too few words or too many repeated ones) and ``kept`` (neither).

    Every row is judged by itself, so repeated rows get equal verdicts; empty and null texts fail the
    base. Columns named like the results are replaced; all others may have any name.
    """
    m = measures(docs, text_col)
    words, repeated = F.col("measured.n_words"), F.col("measured.n_repeat_words")
    names = [F.when(broken, F.lit(name)) for name, broken in compiled(rules).items()]
    return m.withColumns(
        {
            "broken": F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"),
            "base_failed": (words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * words),
        }
    ).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
