"""Vector arithmetic on array columns and on sparse structs.

A dense vector is ``ARRAY<DOUBLE>``. A sparse one is
``STRUCT<size INT, indices ARRAY<INT>, values ARRAY<DOUBLE>>`` with 0-based ascending indices.
Everything here is row-local: no function shuffles, and all work on streaming frames too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(v: ColumnLike) -> Column:
    return _col(v).cast("array<double>")


def _same_size(size_a: Column, size_b: Column, value: Column) -> Column:
    """``value`` where both sizes agree; otherwise the query fails and names them.

    ``zip_with`` alone would pad the shorter side with NULL.
    """
    message = F.concat(
        F.lit("vectors differ in dimension: "),
        F.coalesce(size_a.cast("string"), F.lit("null")),
        F.lit(" and "),
        F.coalesce(size_b.cast("string"), F.lit("null")),
    )
    return F.when(size_a == size_b, value).otherwise(F.raise_error(message).cast("double"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def sqdist(a: ColumnLike, b: ColumnLike) -> Column:
    """Squared Euclidean distance of two dense vectors."""
    a, b = as_doubles(a), as_doubles(b)
    return _same_size(F.size(a), F.size(b), _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def sqdist_sparse(a: ColumnLike, b: ColumnLike) -> Column:
    """Squared distance of two sparse vectors over the union of their indices."""
    a, b = _col(a), _col(b)
    zero = F.lit(0.0)
    diffs = F.map_zip_with(
        F.map_from_arrays(a["indices"], a["values"]),
        F.map_from_arrays(b["indices"], b["values"]),
        lambda _, x, y: F.coalesce(x, zero) - F.coalesce(y, zero),
    )
    total = F.aggregate(F.map_values(diffs), zero, lambda acc, x: acc + x * x)
    return _same_size(a["size"], b["size"], total)


def sqdist_sparse_dense(sparse: ColumnLike, dense: ColumnLike) -> Column:
    """Squared distance of a sparse and a dense vector in O(d + nnz), as a sum of exact squares.

    Stored positions meet the dense ones by index; ``|x|² - 2x·c + |c|²`` would cancel where a large
    value lies next to its center.
    """
    s, c = _col(sparse), as_doubles(dense)
    zero, d = F.lit(0.0), F.size(c)
    places = F.when(d > 0, F.sequence(F.lit(0), d - 1)).otherwise(F.array().cast("array<int>"))
    diffs = F.map_zip_with(
        F.map_from_arrays(places, c),
        F.map_from_arrays(s["indices"].cast("array<int>"), s["values"].cast("array<double>")),
        lambda _, y, x: F.coalesce(x, zero) - F.coalesce(y, zero),
    )
    total = F.aggregate(F.map_values(diffs), zero, lambda acc, x: acc + x * x)
    return _same_size(s["size"], d, total)


def sqdist_dense_sparse(dense: ColumnLike, sparse: ColumnLike) -> Column:
    return sqdist_sparse_dense(sparse, dense)


def vector_kind(df: DataFrame, name: str) -> str:
    """``dense`` or ``sparse``, by the column's type; anything else is an error."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return "dense"
    if isinstance(kind, T.StructType) and set(kind.names) == {"size", "indices", "values"}:
        return "sparse"
    raise TypeError(f"column {name} is no vector: {kind.simpleString()}")


def same_dimension(df: DataFrame, a: str, b: str) -> Column:
    """Whether two vector columns, each dense or sparse, agree in dimension in a row; null where one is null."""
    sizes = [F.col(c)["size"] if vector_kind(df, c) == "sparse" else F.size(c) for c in (a, b)]
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(known, sizes[0] == sizes[1])


def distance_of(a: str, b: str) -> Callable[[ColumnLike, ColumnLike], Column]:
    """The squared distance of vectors of these kinds."""
    distances = {
        ("dense", "dense"): sqdist,
        ("sparse", "sparse"): sqdist_sparse,
        ("sparse", "dense"): sqdist_sparse_dense,
        ("dense", "sparse"): sqdist_dense_sparse,
    }
    return distances[a, b]


def squared_distance(df: DataFrame, a: str, b: str) -> Column:
    """Squared distance of two vector columns of ``df``, each dense or sparse."""
    return distance_of(vector_kind(df, a), vector_kind(df, b))(a, b)


def vec_add(a: ColumnLike, b: ColumnLike) -> Column:
    a, b = as_doubles(a), as_doubles(b)
    summed = F.zip_with(a, b, lambda x, y: x + y)
    agree = _same_size(F.size(a), F.size(b), F.lit(0.0))
    return F.when(agree.isNotNull(), summed)


def vec_scale(a: ColumnLike, factor: Column | float) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(as_doubles(a), lambda x: x * factor)


def sparsify(dense: ColumnLike, threshold: float) -> Column:
    """Sparse struct of the entries whose absolute value exceeds ``threshold``."""
    v = as_doubles(dense)
    kept = F.filter(
        F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda e: F.abs(e["x"]) > threshold,
    )
    return F.struct(
        F.size(v).alias("size"),
        F.transform(kept, lambda e: e["i"]).alias("indices"),
        F.transform(kept, lambda e: e["x"]).alias("values"),
    )
