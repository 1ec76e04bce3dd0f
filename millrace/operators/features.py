"""Click-log preparation: impute, standardise, tag, hash and assemble.

Apart from the one aggregation for the column statistics every step is row-local. The per-column
expressions are written as SQL text: a log has some forty columns, and one parsed expression is much
cheaper to build than dozens of chained calls.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import entries_of_hashes, hashed_entries, token_hashes
from millrace.operators.sampling import sample_poisson, sample_with_replacement
from millrace.plans.scratch import write_and_read

Stats = Mapping[str, tuple[float, float]]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def impute_zero(df: DataFrame, int_cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.expr(f"coalesce({_quoted(c)}, 0)") for c in int_cols})


def category_tokens(cat_cols: Sequence[str], missing: str = "token") -> Column:
    """``ARRAY<STRING>`` of categories tagged ``position:value``, positions from 0.

    The tag makes equal values of different columns hash apart. ``missing='token'`` keeps a missing
    category as the bare tag, ``'drop'`` leaves it out.
    """
    values = [f"coalesce({_quoted(c)}, '')" for c in cat_cols]
    tokens = [f"concat('{i}:', {v})" for i, v in enumerate(values)]
    if missing == "token":
        return F.expr(f"array({', '.join(tokens)})")
    if missing == "drop":
        present = [f"if({v} != '', {t}, null)" for v, t in zip(values, tokens)]
        return F.expr(f"array_compact(array({', '.join(present)}))")
    raise ValueError(f"unknown rule for missing categories: {missing}")


def column_stats(df: DataFrame, cols: Sequence[str], n: int | None = None) -> DataFrame:
    """One row ``mean_<c>, std_<c>`` with population deviations, from one pass.

    A declared row count ``n`` replaces the counted one as the divisor of both. The sum of squares
    around such a mean is the one around the true mean plus ``count · shift²``.
    """
    aggs = []
    for c in cols:
        x = f"double({_quoted(c)})"
        if n is None:
            mean, std = f"avg({x})", f"stddev_pop({x})"
        else:
            mean = f"sum({x}) / {float(n)}D"
            std = f"sqrt(count({x}) * (var_pop({x}) + power(avg({x}) - {mean}, 2)) / {float(n)}D)"
        aggs += [F.expr(mean).alias(f"mean_{c}"), F.expr(std).alias(f"std_{c}")]
    return df.agg(*aggs)


def collect_stats(stats: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """The statistics row as plain numbers: two per column."""
    row = stats.first()
    return {c: (row[f"mean_{c}"], row[f"std_{c}"]) for c in cols}


def with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds the one-row ``stats`` as struct column ``_stats``.

    A scalar subquery computes the row once and turns it into a constant of the plan: no join, and
    one subquery however many columns use it.
    """
    return df.withColumn("_stats", stats.select(F.struct(*stats.columns)).scalar())


def zscores(cols: Sequence[str], stats: Stats | None = None) -> list[Column]:
    """``(x - mean) / std`` per column, 0.0 where the column is constant.

    Without ``stats`` the frame must carry the column of :func:`with_stats`. Plain numbers (of an
    earlier run) make the result usable on streaming frames.
    """

    def score(c: str) -> Column:
        if stats is None:
            mean, std = f"_stats.{_quoted(f'mean_{c}')}", f"_stats.{_quoted(f'std_{c}')}"
        else:
            mean, std = (f"double('{float(v)!r}')" for v in stats[c])
        return F.expr(f"if({std} = 0D, 0D, (double({_quoted(c)}) - {mean}) / {std})")

    return [score(c) for c in cols]


def binarize(label: Column) -> Column:
    return F.when(label <= 0, -1).otherwise(1)


def assemble(num_ints: int, numeric: str = "numeric", hashed: str = "hashed") -> Column:
    """``ARRAY<STRUCT<idx INT, val DOUBLE>>``: numerics at 1 … m, hashed buckets from m + 1."""
    block = ", ".join(
        f"named_struct('idx', {i + 1}, 'val', {_quoted(numeric)}[{i}])" for i in range(num_ints)
    )
    moved = f"named_struct('idx', e.idx + {num_ints + 1}, 'val', double(e.val))"
    return F.expr(f"concat(array({block}), transform({_quoted(hashed)}, e -> {moved}))")


def libsvm_line(
    label: str,
    num_ints: int,
    digits: int | None = None,
    numeric: str = "numeric",
    hashed: str = "hashed",
) -> Column:
    """``±1 1:x … m:x m+1+bucket:count …``; counts print as integers.

    ``digits`` fixes the decimals of the numeric block, otherwise doubles print in full.
    """

    def text(x: str) -> str:
        return x if digits is None else f"format_string('%.{digits}f', {x})"

    fields = [f"if({_quoted(label)} <= 0, '-1', '1')"]
    fields += [f"concat('{i + 1}:', {text(f'{_quoted(numeric)}[{i}]')})" for i in range(num_ints)]
    counts = f"transform({_quoted(hashed)}, e -> concat(e.idx + {num_ints + 1}, ':', e.val))"
    return F.expr(f"concat_ws(' ', {', '.join(fields)}, {counts})")


def prepare(
    df: DataFrame,
    label: str,
    int_cols: Sequence[str],
    cat_cols: Sequence[str],
    num_features: int,
    missing: str = "token",
    n: int | None = None,
    stats: DataFrame | Stats | None = None,
    engine: str = "arrow",
) -> DataFrame:
    """Adds ``numeric ARRAY<DOUBLE>`` and ``hashed ARRAY<STRUCT<idx, val>>`` and keeps the rest.

    Rows pass once for the statistics (integer columns only reach that scan) and once for the
    transformation. Given ``stats`` there is no first pass and ``df`` may be a stream. With
    ``engine='native'`` only the hash runs in Arrow, and the sums are column expressions.
    """
    filled = impute_zero(df, int_cols)
    if stats is None:
        stats = column_stats(filled, int_cols, n)
    if isinstance(stats, DataFrame):
        filled, stats = with_stats(filled, stats), None
    tokens = category_tokens(cat_cols, missing)
    if engine == "arrow":
        hashed = hashed_entries(tokens, num_features)
    elif engine == "native":
        filled = filled.withColumn("_hashes", token_hashes(tokens))
        hashed = entries_of_hashes(F.col("_hashes"), num_features)
    else:
        raise ValueError(f"unknown engine: {engine}")
    rest = [c for c in df.columns if c not in {label, *int_cols, *cat_cols}]
    return filled.select(
        *rest, label, F.array(*zscores(int_cols, stats)).alias("numeric"), hashed.alias("hashed")
    )


def standardize_and_hash(
    df: DataFrame,
    label: str,
    int_cols: Sequence[str],
    cat_cols: Sequence[str],
    num_features: int,
    fraction: float = 1.0,
    seed: int = 42,
    n: int | None = None,
    key: str | None = None,
    missing: str = "token",
    digits: int | None = None,
    stats: DataFrame | Stats | None = None,
) -> DataFrame:
    """The whole preparation job: sample, standardise, hash; returns LibSVM text in ``value``.

    A declared row count ``n`` is that of ``df``; the statistics divide by ``n * fraction``, the
    declared size of the sample. With ``key`` the sample depends on row keys only, so the statistics
    and the transformation see the same rows whatever the partitioning; without it Spark's sampler
    is used, and its sample written once, so that both see the same one. Given ``stats`` (of the same
    sample) are used as they are.
    """
    if key is not None:
        sampled = sample_poisson(df, key, fraction, seed)
    else:
        sampled = sample_with_replacement(df, fraction, seed)
        if fraction != 1.0:
            sampled = write_and_read(sampled, "sample")
    declared = None if n is None else n * fraction
    ready = prepare(sampled, label, int_cols, cat_cols, num_features, missing, declared, stats)
    return ready.select(libsvm_line(label, len(int_cols), digits).alias("value"))


def prepared_size(lines: DataFrame) -> DataFrame:
    """One row: number of prepared rows and of the parts that hold them."""
    parts = lines.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    return parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_partitions")
    )
