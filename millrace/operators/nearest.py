"""Nearest-center search and vector sums by cluster, for dense and sparse points.

Points are never shuffled. Centers that fit the model budget (:mod:`millrace.plans.limits`) go to the
tasks whole. Larger center tables are written to the shared folder once, and every task streams them
in blocks past a chunk of its points, whose running minimum stays in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from millrace.functions.vectors import distance_of, vector_kind
from millrace.plans.limits import model_budget
from millrace.plans.scratch import remove, write_table

NO_CENTER = -1
LARGEST = np.finfo(np.float64).max
TILE_CELLS = 1 << 17
LEAST_TILE_ROWS = 64
#: Bytes of vectors that meet a streamed center table together.
CHUNK_BYTES = 64 * 1024 * 1024
#: Dimensions of one row of partial sums.
BLOCK = 512
# Below this part of |x|² + |c|², the short form of a sparse distance is replaced by the exact one.
CANCELLING = 1e-3
#: Sparse vectors that store at least this part of their cells are searched as filled tiles.
MOSTLY_STORED = 0.25
NEAREST_TYPE = "struct<sqdist:double,cid:int>"


@dataclass(frozen=True)
class Centers:
    """A center matrix small enough to live in every task; rows ascend by id."""

    ids: np.ndarray
    matrix: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, centers: pa.Array) -> Centers:
        """From Arrow columns; the centers are dense or sparse."""
        numbers = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(numbers, kind="stable")
        numbers = numbers[order]
        if len(numbers) and (numbers[0] < NO_CENTER or numbers[-1] > np.iinfo(np.int32).max):
            raise ValueError(f"center ids must fit INT: {numbers[0]} to {numbers[-1]}")
        if pa.types.is_struct(centers.type):
            sparse = SparseRows.of(centers)
            every = np.arange(len(numbers))
            matrix = sparse.filled(every, int(sparse.size[0]) if len(numbers) else 0)
        else:
            matrix = vector_matrix(centers, None)
        return cls(numbers, matrix[order])

    @cached_property
    def squares(self) -> np.ndarray:
        return np.einsum("ij,ij->i", self.matrix, self.matrix)

    @cached_property
    def by_dimension(self) -> np.ndarray:
        return np.ascontiguousarray(self.matrix.T)


def center_size(centers: DataFrame) -> Column:
    """Dimension of a dense or sparse ``center``."""
    return F.col("center.size") if vector_kind(centers, "center") == "sparse" else F.size("center")


def center_bytes(centers: DataFrame) -> int:
    """Size of the centers as a matrix; centers of different dimension are an error."""
    size = center_size(centers).cast("bigint")
    one = centers.agg(F.sum(size * 8 + 8), F.min(size), F.max(size)).first()
    if one[1] != one[2]:
        raise ValueError(f"centers differ in dimension: {one[1]} and {one[2]}")
    return one[0] or 0


def plain_centers(centers: DataFrame) -> DataFrame:
    """``(cid, center)`` with doubles."""
    kind = "struct<size:int,indices:array<int>,values:array<double>>"
    if vector_kind(centers, "center") == "dense":
        kind = "array<double>"
    return centers.select("cid", F.col("center").cast(kind).alias("center"))


def collect_centers(centers: DataFrame, budget: int | None = None) -> Centers | None:
    """The centers as a matrix, or None if they exceed the budget. Counted before collected."""
    budget = model_budget(centers.sparkSession) if budget is None else budget
    kept = plain_centers(centers).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if center_bytes(kept) > budget:
            return None
        table = kept.toArrow().combine_chunks()
        return Centers.of(_column(table, "cid"), _column(table, "center"))
    finally:
        kept.unpersist()


def _column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name)
    return chunks.combine_chunks() if chunks.num_chunks != 1 else chunks.chunk(0)


@dataclass(frozen=True)
class CenterTable:
    """Centers of any number, in files of the shared folder that a task reads ``rows`` at a time."""

    files: list[str]
    rows: int
    path: str

    @classmethod
    def write(cls, centers: DataFrame, budget: int) -> CenterTable:
        """A block takes at most half the budget, but for a single center that alone is larger."""
        plain = plain_centers(centers)
        widest = plain.agg(F.max(center_size(plain))).first()[0] or 0
        table, path = write_table(plain, "centers")
        return cls(table.inputFiles(), max(1, budget // (2 * (8 * widest + 8))), path)

    def blocks(self) -> Iterator[Centers]:
        for name in self.files:
            system, place = fs.FileSystem.from_uri(name.replace("s3a://", "s3://", 1))
            with system.open_input_file(place) as file:
                for batch in pq.ParquetFile(file).iter_batches(self.rows):
                    yield Centers.of(batch.column("cid"), batch.column("center"))


# --- vectors of one Arrow batch ------------------------------------------------------------------


def vector_matrix(column: pa.Array, width: int | None) -> np.ndarray:
    """Rows × dimension matrix of a list column; all rows must have ``width`` values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    width = (int(sizes[0]) if len(sizes) else 0) if width is None else width
    if column.null_count:
        raise ValueError(f"vectors differ in dimension: null and {width}")
    wrong = np.flatnonzero(sizes != width)
    if len(wrong):
        raise ValueError(f"vectors differ in dimension: {sizes[wrong[0]]} and {width}")
    flat = column.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(sizes), width)


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    diff = x - c
    return np.einsum("ij,ij->i", diff, diff)


def _search_all(x: np.ndarray, model: Centers) -> tuple[np.ndarray, np.ndarray]:
    """Running minimum over the centers; a distance must be below the largest double to count."""
    best, at = np.full(len(x), LARGEST), np.full(len(x), NO_CENTER, np.int64)
    for j in range(len(model.ids)):
        d = _exact(x, model.matrix[j])
        closer = d < best
        best[closer], at[closer] = d[closer], j
    return best, at


def _compare(
    x: np.ndarray, candidates: np.ndarray, model: Centers
) -> tuple[np.ndarray, np.ndarray]:
    """Exact minimum over the marked centers of each row; every row has at least one."""
    best, at = np.empty(len(x)), np.empty(len(x), np.int64)
    most = int(candidates.sum(axis=1).max(initial=1))
    rows = max(1, TILE_CELLS // (most * max(1, x.shape[1])))
    for lo in range(0, len(x), rows):
        r, c = np.nonzero(candidates[lo : lo + rows])
        d = _exact(x[lo + r], model.matrix[c])
        first = np.flatnonzero(np.diff(r, prepend=-1))
        low = np.minimum.reduceat(d, first)
        lowest = np.flatnonzero(d == np.repeat(low, np.diff(first, append=len(r))))
        winner = lowest[np.flatnonzero(np.diff(r[lowest], prepend=-1))]
        best[lo : lo + rows], at[lo : lo + rows] = low, c[winner]
    return best, at


def _screen(
    products: np.ndarray, x_sq: np.ndarray, width: int, model: Centers
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which centers may be nearest, by ``|x|² - 2x·c + |c|²`` from the ``products`` x·c.

    That form cancels, so it only screens: a center survives if rounding could put it first. Returns
    the survivors, the first of each row, the rows where several survive and the rows out of the
    range in which the estimate holds (NaN, infinite, huge). ``products`` becomes the estimate
    without ``|x|²``.
    """
    products *= -2.0
    products += model.squares
    scale = x_sq + model.squares.max()
    slack = 16.0 * (width + 4) * np.finfo(np.float64).eps * scale
    survivors = products <= (products.min(axis=1) + slack)[:, None]
    number = survivors.sum(axis=1)
    odd = (number == 0) | ~(scale < LARGEST / 8)
    tied = (number > 1) & ~odd
    return survivors, survivors.argmax(axis=1), np.flatnonzero(tied), np.flatnonzero(odd)


def _search_tile(
    x: np.ndarray, model: Centers, distances: bool
) -> tuple[np.ndarray | None, np.ndarray]:
    """Exact nearest center: one matrix product, and exact distances where that cannot decide.

    A returned distance is always the exact one.
    """
    x_sq = np.einsum("ij,ij->i", x, x)
    survivors, at, tied, odd = _screen(x @ model.matrix.T, x_sq, x.shape[1], model)
    best = _exact(x, model.matrix[at]) if distances else None
    for rows, found in (
        (tied, _compare(x[tied], survivors[tied], model) if len(tied) else None),
        (odd, _search_all(x[odd], model) if len(odd) else None),
    ):
        if found is not None:
            at[rows] = found[1]
            if distances:
                best[rows] = found[0]
    return best, at


def _tiles(x: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Row slices whose working matrices stay in the processor cache where possible."""
    rows = max(LEAST_TILE_ROWS, TILE_CELLS // max(k, x.shape[1], 1))
    for i in range(0, len(x), rows):
        yield x[i : i + rows]


def search(
    x: np.ndarray, model: Centers, distances: bool = True
) -> tuple[np.ndarray | None, np.ndarray]:
    """Squared distance and *position* of the nearest center; ties go to the smallest id.

    Position is ``NO_CENTER`` for a point that compares with no center (NaN, infinite). Without
    ``distances`` only positions are worked out.
    """
    k = len(model.ids)
    if k == 0 or not len(x):
        return np.full(len(x), LARGEST), np.full(len(x), NO_CENTER, np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        if not np.isfinite(model.squares).all():
            return _search_all(x, model)
        best, at = zip(*(_search_tile(tile, model, distances) for tile in _tiles(x, k)))
    return (np.concatenate(best) if distances else None), np.concatenate(at)


def _row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive row slices; ``starts`` has one more entry than there are rows."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]))
    filled = np.flatnonzero(np.diff(starts))
    if len(filled):
        out[filled] = np.add.reduceat(values, starts[:-1][filled], axis=0)
    return out


@dataclass(frozen=True)
class SparseRows:
    """Sparse structs of an Arrow batch: all stored entries in a row, and where each vector's begin."""

    size: np.ndarray
    starts: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    @classmethod
    def of(cls, column: pa.StructArray, width: int | None = None) -> SparseRows:
        """All vectors must have ``width`` dimensions, if given, or those of the first."""
        size = column.field("size").to_numpy(zero_copy_only=False)
        if column.null_count or len(size):
            width = size[0] if width is None and len(size) else width
            if column.null_count or (size != width).any():
                wrong = "null" if column.null_count else size[size != width][0]
                raise ValueError(f"vectors differ in dimension: {wrong} and {width}")
        lists, stored = column.field("indices"), column.field("values")
        starts, first = lists.offsets.to_numpy().astype(np.int64), stored.offsets.to_numpy()
        idx = lists.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
        val = stored.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]]
        return cls(size, starts - starts[0], idx, val)

    def filled_run(self, lo: int, hi: int, width: int) -> np.ndarray:
        """The vectors ``lo`` to ``hi`` as a matrix, with one write in a row of cells."""
        ends = self.starts[lo : hi + 1]
        x = np.zeros((hi - lo, width))
        first = np.repeat(np.arange(hi - lo, dtype=np.int64) * width, np.diff(ends))
        x.reshape(-1)[first + self.idx[ends[0] : ends[-1]]] = self.val[ends[0] : ends[-1]]
        return x

    def filled(self, rows: np.ndarray, width: int) -> np.ndarray:
        """These vectors as a matrix."""
        lengths = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(lengths)
        entries = np.arange(lengths.sum()) + np.repeat(self.starts[rows] - (ends - lengths), lengths)
        x = np.zeros((len(rows), width))
        x[np.repeat(np.arange(len(rows)), lengths), self.idx[entries]] = self.val[entries]
        return x


def search_sparse(rows: SparseRows, model: Centers) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`search` for sparse vectors, touching stored entries only unless most cells are stored.

    ``|c|² + Σ x(x - 2c)`` over the stored entries finds the nearest center. A row it cannot decide,
    or whose distance is so small against the squares that cancelling would show, is filled up and
    compared exactly with the centers that remain.
    """
    k, width = model.matrix.shape
    size, starts, idx, val = rows.size, rows.starts, rows.idx, rows.val
    best, at = np.full(len(size), LARGEST), np.full(len(size), NO_CENTER, np.int64)
    if k == 0:
        return best, at
    if len(size) and len(val) >= MOSTLY_STORED * len(size) * width:
        tile = max(1, TILE_CELLS // max(1, width))
        for lo in range(0, len(size), tile):
            hi = min(lo + tile, len(size))
            best[lo:hi], at[lo:hi] = search(rows.filled_run(lo, hi, width), model)
        return best, at
    with np.errstate(over="ignore", invalid="ignore"):
        x_sq = _row_sums(val * val, starts)
        step = max(1, TILE_CELLS // max(k, int(np.diff(starts).max(initial=1)) * k))
        for lo in range(0, len(size), step):
            hi = min(lo + step, len(size))
            cut = slice(starts[lo], starts[hi])
            products = model.by_dimension[idx[cut]] * val[cut, None]
            products = _row_sums(products, starts[lo : hi + 1] - starts[lo])
            survivors, near, tied, odd = _screen(products, x_sq[lo:hi], width, model)
            here = np.arange(hi - lo)
            at[lo:hi] = near
            best[lo:hi] = x_sq[lo:hi] + products[here, near]
            cancelled = np.flatnonzero(best[lo:hi] < CANCELLING * (x_sq[lo:hi] + model.squares[near]))
            close = np.setdiff1d(np.union1d(tied, cancelled), odd)
            some = max(1, TILE_CELLS // max(1, width))
            for i in range(0, len(close), some):
                part = close[i : i + some]
                x = rows.filled(lo + part, width)
                best[lo + part], at[lo + part] = _compare(x, survivors[part], model)
            for i in range(0, len(odd), some):
                part = odd[i : i + some]
                x = rows.filled(lo + part, width)
                best[lo + part], at[lo + part] = _search_all(x, model)
    return best, at


def _ids(at: np.ndarray, model: Centers) -> np.ndarray:
    return np.append(model.ids, NO_CENTER)[at].astype(np.int32)


# --- nearest center ------------------------------------------------------------------------------


def nearest_ids(column: pa.Array, blocks: Iterable[Centers]) -> tuple[np.ndarray, np.ndarray]:
    """Distance and id of the nearest center of all ``blocks``, which may come in any order."""
    best, cids = np.full(len(column), LARGEST), np.full(len(column), NO_CENTER, np.int32)
    points = None
    for model in blocks:
        width = model.matrix.shape[1] if len(model.ids) else None
        if pa.types.is_struct(column.type):
            points = SparseRows.of(column, width)
            found, at = search_sparse(points, model)
        else:
            points = vector_matrix(column, width) if points is None or width is None else points
            found, at = search(points, model)
        ids = _ids(at, model)
        closer = (at != NO_CENTER) & ((found < best) | ((found == best) & (ids < cids)))
        best[closer], cids[closer] = found[closer], ids[closer]
    return best, cids


def nearest_column(points: DataFrame, features: str, model: Centers | CenterTable) -> Column:
    """``STRUCT<sqdist, cid>`` of the nearest center; only the vectors travel to Python."""

    def answer(held: list[pa.Array]) -> Iterator[pa.Array]:
        column = held[0] if len(held) == 1 else pa.concat_arrays(held)
        blocks = [model] if isinstance(model, Centers) else model.blocks()
        best, cids = nearest_ids(column, blocks)
        lost = cids == NO_CENTER
        near = pa.StructArray.from_arrays([pa.array(best, mask=lost), pa.array(cids)], names=["sqdist", "cid"])
        start = 0
        for batch in held:
            yield near.slice(start, len(batch))
            start += len(batch)

    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if isinstance(model, Centers) or size >= CHUNK_BYTES:
                yield from answer(held)
                held, size = [], 0
        if held:
            yield from answer(held)

    vector_kind(points, features)
    return F.arrow_udf(nearest, NEAREST_TYPE)(F.col(features))


def _nearest_native(points: DataFrame, centers: DataFrame, features: str) -> DataFrame:
    """The same search as plain column expressions over an uncorrelated scalar subquery.

    The subquery folds the centers to one value that Spark attaches to the plan, so the points see
    no join and no exchange.
    """
    packed = plain_centers(centers).agg(F.collect_list(F.struct("cid", "center"))).scalar()
    near = _native_minimum(points, centers, features, features)
    return points.withColumn("_centers", packed).withColumn("_near", _or_lost(near))


def _or_lost(near: Column | str) -> Column:
    """No center at all where none compares."""
    lost = F.struct(F.lit(None).cast("double").alias("sqdist"), F.lit(NO_CENTER).alias("cid"))
    return F.coalesce(near, lost)


def _native_minimum(points: DataFrame, centers: DataFrame, features: str, value: str) -> Column:
    """Nearest of the array ``_centers`` to ``value``, a column of the kind of ``features``; null if none compares."""
    distance = distance_of(vector_kind(points, features), vector_kind(centers, "center"))
    distances = F.transform(
        "_centers",
        lambda c: F.struct(distance(F.col(value), c["center"]).alias("sqdist"), c["cid"].alias("cid")),
    )
    return F.array_min(F.filter(distances, lambda e: e["sqdist"] < float(LARGEST)))


def _nearest_native_blocks(points: DataFrame, centers: DataFrame, features: str, budget: int) -> DataFrame:
    """The native search for centers beyond the budget: one scan, nothing written.

    Centers are packed into blocks of half the budget, on average; each point meets every block in a join
    by block number, and its least distance is kept. Points travel once for each block, so the Arrow
    engine, which moves none, is the better choice for such tables.
    """
    blocks = max(1, math.ceil(2 * center_bytes(centers) / max(1, budget)))
    packed = (
        plain_centers(centers)
        .groupBy(F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("block"))
        .agg(F.collect_list(F.struct("cid", "center")).alias("_centers"))
    )
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    spread = points.select(F.struct(*points.columns).alias("row"), F.monotonically_increasing_id().alias("uid"))
    met = spread.withColumn("block", F.explode(every)).join(packed.hint("merge"), "block")
    near = met.select("uid", "row", _native_minimum(points, centers, features, f"row.`{features}`").alias("near"))
    least = near.groupBy("uid").agg(F.any_value("row").alias("row"), F.min("near").alias("near"))
    return least.select("row.*", _or_lost("near").alias("_near"))


def model_of(centers: DataFrame, budget: int) -> Centers | CenterTable:
    """The centers in the form in which tasks can hold or stream them."""
    held = collect_centers(centers, budget)
    return CenterTable.write(centers, budget) if held is None else held


def nearest_center(
    points: DataFrame,
    centers: DataFrame | Centers | CenterTable,
    features: str = "features",
    engine: str = "arrow",
    budget: int | None = None,
) -> DataFrame:
    """Adds ``cid`` and ``sqdist`` of the nearest center to every dense or sparse point.

    Strictly smaller distances win, ties go to the smallest ``cid``. A point with no comparable
    distance gets ``cid = -1`` and a NULL distance. Centers are dense or sparse. ``engine='native'``
    stays in the JVM, whatever their number. With centers beyond ``budget`` bytes the Arrow engine reads
    a written copy of them, which stays in the shared folder as long as the result may be asked for.
    """
    budget = model_budget(points.sparkSession) if budget is None else budget
    if engine == "native":
        if isinstance(centers, Centers):
            raise ValueError("the native engine takes the centers as a DataFrame")
        if center_bytes(centers) <= budget:
            found = _nearest_native(points, centers, features)
        else:
            found = _nearest_native_blocks(points, centers, features, budget)
    elif engine == "arrow":
        model = centers if isinstance(centers, Centers | CenterTable) else model_of(centers, budget)
        found = points.withColumn("_near", nearest_column(points, features, model))
    else:
        raise ValueError(f"unknown engine: {engine}")
    return found.select(
        *[c for c in points.columns], F.col("_near.cid").alias("cid"),
        F.col("_near.sqdist").alias("sqdist"),
    )


def clustering_cost(
    points: DataFrame,
    centers: DataFrame | Centers | CenterTable,
    features: str = "features",
    engine: str = "arrow",
    budget: int | None = None,
) -> DataFrame:
    """One row: sum of squared distances to the nearest centers.

    Points without a comparable distance (``cid = -1``) add nothing. Of centers beyond the budget the
    Arrow engine reads a written copy; there the sum is worked out at once and the copy deleted.
    """
    spark, copy = points.sparkSession, None
    if engine == "arrow" and isinstance(centers, DataFrame):
        centers = model_of(centers, model_budget(spark) if budget is None else budget)
        copy = centers.path if isinstance(centers, CenterTable) else None
    assigned = nearest_center(points.select(features), centers, features, engine, budget)
    cost = assigned.agg(F.coalesce(F.sum("sqdist"), F.lit(0.0)).alias("cost"))
    if copy is None:
        return cost
    value = cost.first()["cost"]
    remove(spark, copy)
    return spark.createDataFrame([(value,)], "cost double")


# --- sums by cluster -----------------------------------------------------------------------------

SUM_TYPE = "cid int, block int, x array<double>, n bigint"
# Stands for a null key within a task; no INT key has this value.
NULL_KEY = -(2**63)
# Block number of the rows that count the points of a cluster, where blocks of zeros are left out.
COUNTS = -1


def block_rows(
    ids: np.ndarray, sums: np.ndarray, counts: np.ndarray, id_type: pa.DataType = pa.int32(), sparse: bool = False
) -> pa.RecordBatch:
    """Partial sums, one row per cluster and BLOCK dimensions.

    With ``sparse`` only blocks with a value are sent, and one row per cluster that counts its points.
    """
    k, d = sums.shape
    blocks = max(1, -(-d // BLOCK))
    if sparse:
        edges = np.arange(0, d, BLOCK)
        used = np.add.reduceat(sums != 0, edges, axis=1) > 0 if d else np.zeros((k, 0), bool)
        row, block = np.nonzero(used)
    else:
        row, block = np.repeat(np.arange(k), blocks), np.tile(np.arange(blocks), k)
    first, last = block * BLOCK, np.minimum((block + 1) * BLOCK, d)
    values = [sums[r, a:b] for r, a, b in zip(row, first, last, strict=True)]
    n = np.zeros(len(row), np.int64) if sparse else counts[row]
    if sparse:
        row, block = np.concatenate((row, np.arange(k))), np.concatenate((block, np.full(k, COUNTS)))
        values += [np.zeros(0)] * k
        n = np.concatenate((n, counts))
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[row], id_type),
            pa.array(block.astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            pa.array(n.astype(np.int64)),
        ],
        names=["cid", "block", "x", "n"],
    )


def add_by_position(sums: np.ndarray, counts: np.ndarray, x: np.ndarray, at: np.ndarray) -> None:
    """Adds each row of ``x`` to the row of ``sums`` given by ``at`` (sorted runs, one reduce)."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.diff(sorted_at, prepend=-1))
    if len(first):
        sums[sorted_at[first]] += np.add.reduceat(x[order], first, axis=0)
        counts[sorted_at[first]] += np.diff(first, append=len(at))


def add_nearest(sums: np.ndarray, counts: np.ndarray, x: np.ndarray, model: Centers) -> None:
    """Adds each row of ``x`` to the sums of its nearest center; rows without one are left out."""
    for tile in _tiles(x, len(model.ids)):
        _, at = search(tile, model, distances=False)
        known = at != NO_CENTER
        if not known.all():
            tile, at = tile[known], at[known]
        add_by_position(sums, counts, tile, at)


def add_nearest_sparse(sums: np.ndarray, counts: np.ndarray, rows: SparseRows, model: Centers) -> None:
    """The same for sparse vectors: their stored entries are added one by one."""
    _, at = search_sparse(rows, model)
    known = at != NO_CENTER
    cells, val = np.repeat(at * sums.shape[1], np.diff(rows.starts)) + rows.idx, rows.val
    if not known.all():
        stored = np.repeat(known, np.diff(rows.starts))
        at, cells, val = at[known], cells[stored], val[stored]
    counts += np.bincount(at, minlength=len(counts))
    # one index an entry: NumPy adds by pairs of them many times slower
    np.add.at(sums.reshape(-1), cells, val)


def _by_dimension(parts: DataFrame) -> DataFrame:
    """Rows of the tasks' blocks one number each, at ``pos`` of their block; a counting row keeps one.

    Blocks are dealt out whole and opened behind the exchange, whose key (cid, block) suits the grouping
    by (cid, block, pos), so nothing is exchanged again.
    """
    others = [c for c in parts.columns if c != "x"]
    return parts.repartition("cid", "block").select(*others, F.posexplode_outer("x").alias("pos", "x"))


def assigned_sums(points: DataFrame, model: Centers, features: str) -> DataFrame:
    """Nearest-center search fused with the sums: ``(cid, block, x, n)`` for blocks of dimensions.

    A task sends at most k·d numbers, as arrays. Of sparse points it sends only blocks with a value, and
    the count of a cluster stands in the row of block ``COUNTS``; at most a tile of points is filled up.
    """
    k, d = model.matrix.shape
    sparse = vector_kind(points, features) == "sparse"

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, d)), np.zeros(k, np.int64)
        for batch in batches:
            if sparse:
                add_nearest_sparse(sums, counts, SparseRows.of(batch.column(0), d), model)
            else:
                add_nearest(sums, counts, vector_matrix(batch.column(0), d), model)
        used = counts > 0
        yield block_rows(model.ids[used], sums[used], counts[used], sparse=sparse)

    parts = _by_dimension(points.select(features).mapInArrow(partial_sums, SUM_TYPE))
    sums = parts.groupBy("cid", "block", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return sums.groupBy("cid", "block").agg(F.transform(packed, lambda e: e["x"]).alias("x"), F.max("n").alias("n"))


def vector_sums(
    df: DataFrame, key: str, features: str = "features", engine: str = "arrow"
) -> DataFrame:
    """Element-wise sums and counts by an integer key, as ``(cid, dim, x, n)``, dim from 0.

    Rows with a null key add up under a null ``cid``; vectors of different length are an error, within
    a task and across. Tasks add up their rows first, so a key that holds a third of all rows sends no
    more than any other. A task's table of sums is emitted and restarted whenever it outgrows the model budget.
    """
    if engine == "native":
        parts = df.select(
            F.col(key).cast("int").alias("cid"),
            F.size(features).alias("width"),
            F.posexplode(F.col(features).cast("array<double>")).alias("dim", "x"),
        )
        return _checked(parts.withColumn("n", F.lit(1).cast("bigint")), ["cid", "dim"])
    if engine != "arrow":
        raise ValueError(f"unknown engine: {engine}")
    limit = model_budget(df.sparkSession)

    def wide_rows(ids: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        rows = block_rows(ids, sums, counts, pa.int64())
        return rows.append_column("width", pa.array(np.full(rows.num_rows, sums.shape[1], np.int32)))

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums, counts = np.zeros(0, np.int64), None, np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = vector_matrix(batch.column(1), None if sums is None else sums.shape[1])
            if sums is None:
                sums = np.zeros((0, x.shape[1]))
            keys = batch.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False)
            merged = np.union1d(ids, keys)
            if len(merged) != len(ids):
                grown, n = np.zeros((len(merged), x.shape[1])), np.zeros(len(merged), np.int64)
                old = np.searchsorted(merged, ids)
                grown[old], n[old] = sums, counts
                ids, sums, counts = merged, grown, n
            add_by_position(sums, counts, x, np.searchsorted(ids, keys))
            if sums.nbytes > limit:
                yield wide_rows(ids, sums, counts)
                ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                sums = np.zeros((0, x.shape[1]))
        if sums is not None and len(ids):
            yield wide_rows(ids, sums, counts)

    picked = df.select(F.col(key).cast("int").cast("bigint").alias("cid"), features)
    parts = picked.mapInArrow(partial_sums, "cid bigint, block int, x array<double>, n bigint, width int")
    sums = _checked(_by_dimension(parts).filter("pos IS NOT NULL"), ["cid", "block", "pos"])
    cid = F.when(F.col("cid") != NULL_KEY, F.col("cid")).cast("int").alias("cid")
    return sums.select(cid, (F.col("block") * BLOCK + F.col("pos")).alias("dim"), "x", "n")


def _checked(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up by cluster and dimension; vectors of different length meet at dimension 0 and are an error."""
    message = F.lit("vectors differ in dimension within one cluster")
    sums = parts.groupBy(*keys).agg(
        F.sum("x").alias("x"), F.sum("n").alias("n"), F.min("width").alias("least"), F.max("width").alias("most")
    )
    same = F.col("least") == F.col("most")
    n = F.when(same, F.col("n")).otherwise(F.raise_error(message).cast("bigint"))
    return sums.select(*keys, "x", n.alias("n"))


def sparse_means(df: DataFrame, key: str, features: str = "features") -> DataFrame:
    """``(cid, center, n)`` of sparse vectors, centers sparse as well; entries are added by cluster and index.

    Each task adds up first; no vector is filled up. Vectors of different dimension are an error.
    """
    keyed = df.select(F.col(key).alias("cid"), F.col(features).alias("v"))
    entries = keyed.select("cid", F.inline(F.arrays_zip(F.col("v.indices").alias("i"), F.col("v.values").alias("x"))))
    entries = entries.toDF("cid", "i", "x").groupBy("cid", "i").agg(F.sum("x").alias("x"))
    rows = entries.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("entries"))
    sizes = keyed.groupBy("cid").agg(
        F.count(F.lit(1)).alias("n"), F.min("v.size").alias("least"), F.max("v.size").alias("size")
    )
    joined = sizes.join(rows.hint("merge"), sizes["cid"].eqNullSafe(rows["cid"]), "left").select(sizes["*"], "entries")
    message = F.lit("vectors differ in dimension within one cluster")
    size = F.when(F.col("least") == F.col("size"), F.col("size")).otherwise(F.raise_error(message).cast("int"))
    none = F.array().cast("array<struct<i:int,x:double>>")
    stored = F.coalesce("entries", none)
    center = F.struct(
        size.alias("size"),
        F.transform(stored, lambda e: e["i"]).alias("indices"),
        F.transform(stored, lambda e: e["x"] / F.col("n")).alias("values"),
    )
    return joined.select("cid", center.alias("center"), "n")


def means_of(sums: DataFrame) -> DataFrame:
    """``(cid, dim, x, n)`` with x divided by the count."""
    return sums.select("cid", "dim", (F.col("x") / F.col("n")).alias("x"), "n")


def vector_means(
    df: DataFrame, key: str, features: str = "features", engine: str = "arrow"
) -> DataFrame:
    return means_of(vector_sums(df, key, features, engine))


def centers_from_means(means: DataFrame) -> DataFrame:
    """``(cid, center, n)`` from long form; a group holds the d values of one center."""
    packed = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return means.groupBy("cid").agg(
        F.transform(packed, lambda e: e["x"]).alias("center"), F.max("n").alias("n")
    )
