"""Removal of lines that spread over many sites, found by sketches of distinct sites.

Every line is known by the MD5 of its trimmed text. A HyperLogLog sketch of sites per line is built in
the tasks and merged by aggregation, so a line on a third of all pages is one small row per task.
Lines whose estimate lies near the threshold get an exact count of distinct sites; those clearly above
are boilerplate at once. Boilerplate lines then meet the documents' line hashes in a join, which gives
the places to cut for each text that holds one; a text's other places are looked up in its lines, so
the work grows with the lines. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import text_or_empty
from millrace.plans.scratch import remove, write_and_read, write_table

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: Estimates between these parts of the threshold are counted exactly; 2^SKETCH_BITS registers have a
#: standard error of about 3 %, so the band lies more than ten errors away on either side.
BAND, SKETCH_BITS = (0.6, 1.6), 10

SPACE = " \t\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """16 bytes that stand for a line without white space around it; null if nothing is left."""
    bare = F.trim(line, F.lit(SPACE))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def spread_lines(docs: DataFrame, text_col: str, site_col: str, min_sites: int) -> tuple[DataFrame, str]:
    """``key`` of every line that occurs on ``min_sites`` sites or more, as a written table, and its path.

    Rows without a site share one. With a threshold of 1 or less every line qualifies.
    """
    lines = docs.select(
        F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
        F.explode(F.split(text_or_empty(F.col(text_col)), "\n")).alias("line"),
    ).select("site", line_key(F.col("line")).alias("key"))
    lines = lines.filter(F.col("key").isNotNull())
    sketches = lines.groupBy("key").agg(F.hll_sketch_agg("site", SKETCH_BITS).alias("sites"))
    estimated = sketches.select("key", F.hll_sketch_estimate("sites").alias("estimate"))
    low, high = (part * min_sites for part in BAND)
    possible, path = write_table(estimated.filter(F.col("estimate") >= min(low, min_sites)), "spread")
    near = possible.filter(F.col("estimate") <= max(high, min_sites)).select("key")
    exact = (
        lines.join(near, "key", "left_semi")
        .groupBy("key", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("key")
        .agg(F.sum("one").alias("sites"))
        .filter(F.col("sites") >= min_sites)
        .select("key")
    )
    clear = possible.filter(F.col("estimate") > max(high, min_sites)).select("key")
    written = write_table(clear.unionByName(exact), "boilerplate")
    remove(docs.sparkSession, path)
    return written


def remove_spread_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
) -> DataFrame:
    """``docs`` with its text rid of boilerplate lines, and ``n_lines``, ``n_removed``.

    ``n_lines`` counts the lines with anything but white space before removal. A text without
    boilerplate stays as it is, a null text stays null. Every row stays, one with nothing but
    boilerplate with an empty text. Rows may share an id, and a null id is an id. An empty table gives
    an empty result. Columns named like the results are replaced; all others may have any name. The
    result reads a written table of the places to cut, which stays in the shared folder.
    """
    boilerplate, path = spread_lines(docs, text_col, site_col, min_sites)
    id_, text = F.col(id_col).alias("id"), F.md5(F.col(text_col)).alias("text")
    lines = docs.select(id_, text, F.posexplode(F.split(F.col(text_col), "\n")).alias("place", "line"))
    hits = (
        lines.select("id", "text", "place", line_key(F.col("line")).alias("key"))
        .filter(F.col("key").isNotNull())
        .join(boilerplate, "key", "left_semi")
        .groupBy("id", "text")
        .agg(F.collect_set("place").alias("places"))
    )
    hits = write_and_read(hits, "line-hits")
    remove(docs.sparkSession, path)
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*others).alias("row"), id_, text, F.col(text_col).alias("whole"))
    found = hits.select(F.col("id").alias("hit_id"), F.col("text").alias("hit_text"), "places")
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text") == F.col("hit_text"))
    marked = rows.join(found.hint("merge"), same, "left")
    # one struct bound to a variable: the text is split once, however many lines are looked up
    split = F.split("whole", "\n")
    count = F.size(F.filter(split, lambda x: F.trim(x, F.lit(SPACE)) != ""))
    left = F.transform(
        F.array(F.struct(split.alias("lines"), F.col("places").alias("places"))),
        lambda d: F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(d["lines"]) - 1), d["places"]), lambda i: d["lines"][i]
        ),
    )[0]
    clean = F.when(F.col("places").isNull(), F.col("whole")).otherwise(F.array_join(left, "\n"))
    result = marked.select(
        "row",
        clean.alias("clean"),
        F.when(F.col("whole").isNull(), 0).otherwise(count).cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_removed"),
    )
    kept = [(F.col("clean") if c.lower() == text_col.lower() else F.col(f"row.`{c}`")).alias(c) for c in others]
    return result.select(*kept, "n_lines", "n_removed")
