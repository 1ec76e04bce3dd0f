"""The trie of conversation prefixes, from sorted sequences and range minima of their shared lengths.

A conversation is the sequence of its turns' digests. Equal sequences become one; the distinct ones are
sorted, and each is compared with its predecessor: the number of turns they share is an entry of the
LCP array. Sequences that begin with a given prefix lie side by side, so a node of the trie is an
interval of the order. Every place where two neighbours part and every end of a sequence names a
candidate prefix; its interval is found by two independent binary searches, to the left and to the right,
over a sparse table of range minima of the LCPs. No stack and no pass from node to node is needed, and
all numbers of a node are differences of running sums over its interval.

The order is cut into blocks of bounded size, and a block is searched by itself. A node whose interval
reaches over a block's end is known there in part only: such parts (at most the depths shared across the
two ends of a block) carry the prefix's digest and add up by aggregation, so a first turn that a third of
all conversations share costs one row per block. A range partition's first and last sequence are
compared on the driver, two rows per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import text_or_empty
from millrace.plans.scratch import remove, write_and_read, write_table

#: Bytes of a turn's digest; conversations of a chunk of member ids.
WIDTH, CHUNK = 16, 8192
#: Sequences and turns from which a block is closed.
BLOCK_ROWS, BLOCK_TURNS = 8192, 200_000

NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id`` and ``turns``, an array of (digest of role and text, UTF-8 bytes of the text).

    Turns are put in order of their number, null first; turns with equal numbers in order of their
    digests, and repeated rows are turns of their own. Null roles and texts count as empty. Rows
    without a conversation id belong to none and are left out.
    """
    role, text = text_or_empty(F.col(role_col)), text_or_empty(F.col(text_col))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.md5(told).alias("digest"),
        F.octet_length(text).alias("bytes"),
    )
    in_order = F.sort_array(F.collect_list(F.struct("turn", "digest", "bytes")))
    return turns.groupBy("conv_id").agg(
        F.transform(in_order, lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns")
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id): for each key, chunks of its ids as text."""
    key, ids, out = None, [], []

    def closed():
        out.append((key, ids[0], len(ids), ",".join(map(str, ids))))

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key or len(ids) >= CHUNK:
                if ids:
                    closed()
                key, ids = k, []
            ids.append(c)
        yield _batch(out, CHUNKS)
        out = []
    if ids:
        closed()
    yield _batch(out, CHUNKS)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks: for each key its least id, how many there are and the digest of all of them."""
    key, first, n, digest, out = None, None, 0, None, []
    for batch in batches:
        for k, c, count, text in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, first, n, digest.hexdigest()))
                key, first, n, digest = k, c, 0, hashlib.sha256()
            digest.update(("," if n else "").encode() + text.encode())
            n += count
        yield _batch(out, ENDS)
        out = []
    if key is not None:
        out.append((key, first, n, digest.hexdigest()))
    yield _batch(out, ENDS)


CHUNKS = pa.schema([("key", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
ENDS = pa.schema([("key", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences share from the start."""
    n, k = min(len(a), len(b)), 0
    while k < n and a[k : k + WIDTH] == b[k : k + WIDTH]:
        k += WIDTH
    return k // WIDTH


BLOCKS = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("lcp", pa.list_(pa.int32())),
        ("next_lcp", pa.int32()),
        ("turns", pa.list_(pa.int32())),
        ("bytes", pa.list_(pa.int32())),
        ("n", pa.list_(pa.int64())),
        ("conv_id", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.string())),
        ("first_path", pa.binary()),
        ("last_path", pa.binary()),
        ("begins", pa.bool_()),
        ("closes", pa.bool_()),
    ]
)
BLOCK_TYPE = (
    "part int, block int, lcp array<int>, next_lcp int, turns array<int>, bytes array<int>, n array<bigint>,"
    " conv_id array<bigint>, ends array<string>, first_path binary, last_path binary, begins boolean, closes boolean"
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path, bytes, n, conv_id, ends) as blocks, one row each; the LCPs at a partition's ends are open."""
    part, number, before, rows, turns = TaskContext.get().partitionId(), 0, None, [], 0

    def block(after: int | None) -> pa.RecordBatch:
        row = (
            part, number, [r[0] for r in rows], after, [len(r[2]) for r in rows],
            [b for r in rows for b in r[2]], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows],
            rows[0][1], rows[-1][1], number == 0, after is None,
        )
        return _batch([row], BLOCKS)

    for batch in batches:
        for path, sizes, n, conv, ends in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
            lcp = None if before is None else shared_turns(before, path)
            if len(rows) >= BLOCK_ROWS or turns >= BLOCK_TURNS:
                yield block(lcp)
                rows, turns, number = [], 0, number + 1
            if len(rows) > 1:
                rows[-1] = (rows[-1][0], None, *rows[-1][2:])  # only a block's first and last path are kept
            rows.append((lcp, path, sizes, n, conv, ends))
            turns, before = turns + len(sizes), path
    if rows:
        yield block(None)


class RangeMinima:
    """Sparse table: least value of every run whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels, width = [values], 1
        while 2 * width <= len(values):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least value from ``first`` to ``last``, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k, table in enumerate(self.levels):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
        return out

    def left(self, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first row that shares ``depth`` turns with the row at ``place``, all between them included."""
        at = place.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table, to = self.levels[k], at - (1 << k)
            inside = np.flatnonzero(to >= 0)
            inside = inside[table[to[inside] + 1] >= depth[inside]]
            at[inside] = to[inside]
        return at

    def right(self, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last such row."""
        at, last = place.copy(), len(self.levels[0]) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            table, to = self.levels[k], at + (1 << k)
            inside = np.flatnonzero(to <= last)
            inside = inside[table[at[inside] + 1] >= depth[inside]]
            at[inside] = to[inside]
        return at


PARTS = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("side", pa.int8()),
        ("depth", pa.int64()),
        ("key", pa.binary()),
        ("parent_key", pa.binary()),
        ("parent_side", pa.int8()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("all_bytes", pa.int64()),
        ("own_bytes", pa.int64()),
        ("bytes_above", pa.int64()),
        ("ends", pa.string()),
    ]
)
PART_TYPE = (
    "part int, block int, side tinyint, depth bigint, key binary, parent_key binary, parent_side tinyint,"
    " conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint,"
    " all_bytes bigint, own_bytes bigint, bytes_above bigint, ends string"
)


def _prefix_keys(path: bytes, most: int) -> list[bytes]:
    """Digests of the prefixes of 0 to ``most`` turns."""
    digest, keys = hashlib.blake2b(digest_size=WIDTH), []
    for d in range(most + 1):
        keys.append(digest.copy().digest())
        digest.update(path[d * WIDTH : (d + 1) * WIDTH])
    return keys


def block_nodes(row: dict, before: int, after: int) -> pa.RecordBatch:
    """The nodes, whole or in part, of one block; ``before`` and ``after`` are the LCPs at its two ends."""
    lengths = np.array(row["turns"], np.int64)
    lcp = np.array([before, *row["lcp"][1:]], np.int64)
    counts, convs = np.array(row["n"], np.int64), np.array(row["conv_id"], np.int64)
    m = len(lcp)
    inner = lcp.copy()
    inner[0] = -1  # searches stay within the block
    table, least_id = RangeMinima(inner), RangeMinima(convs)
    # candidates: where neighbours part, and where sequences end
    place = np.concatenate((np.arange(1, m), np.arange(m)))
    depth = np.concatenate((lcp[1:], lengths))
    first, last = table.left(place, depth), table.right(place, depth)
    interval, which = np.unique(first * m + last, return_inverse=True)
    l, r = interval // m, interval % m
    deepest = np.full(len(interval), -1, np.int64)
    np.maximum.at(deepest, which, depth)
    splits = np.bincount(which[: m - 1], minlength=len(interval))
    shallowest = np.maximum(inner[l], np.append(inner, -1)[r + 1]) + 1
    # a row per depth at which an interval is a node's
    times = deepest - shallowest + 1
    of = np.repeat(np.arange(len(interval)), times)
    d = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + shallowest[of]
    a, b = l[of], r[of]

    start = np.cumsum(lengths) - lengths
    running = np.concatenate(([0], np.cumsum(np.array(row["bytes"], np.int64))))

    def bytes_of(j: np.ndarray, turns: np.ndarray) -> np.ndarray:
        return running[start[j] + turns] - running[start[j]]

    everyone = np.arange(m)
    total = bytes_of(everyone, lengths)
    own = total - bytes_of(everyone, np.maximum(lcp, 0))
    leaf = np.append(lcp[1:], after) < lengths

    def summed(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[b + 1] - sums[a]

    shared = np.maximum(np.maximum(lcp[a], d - 1), 0)
    own_bytes = summed(own) - own[a] + total[a] - bytes_of(a, shared)
    above = bytes_of(a, np.maximum(d - 1, 0))
    children = ((lengths[a] > d) & (lcp[a] <= d)).astype(np.int64)
    children += np.where(d == deepest[of], splits[of], 0)

    up = np.maximum(d - 1, 0)
    top = d == shallowest[of]
    pl, pr = a.copy(), b.copy()
    pl[top], pr[top] = table.left(a[top], up[top]), table.right(a[top], up[top])

    def is_open(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((x == 0) & (at <= before)) | ((y == m - 1) & (at <= after))

    opened, parent_open = is_open(a, b, d), is_open(pl, pr, up)
    parent = least_id.least(pl, pr)
    keys, parents = [None] * len(d), [None] * len(d)
    for path, rows in (("first_path", opened & (a == 0)), ("last_path", opened & (a != 0))):
        digests = _prefix_keys(row[path], int(d[rows].max(initial=-1)))
        for i in np.flatnonzero(rows):
            keys[i], parents[i] = digests[d[i]], digests[d[i] - 1] if d[i] else None
    ends = [None] * len(d)
    for i in np.flatnonzero(lengths[a] == d):
        ends[i] = row["ends"][a[i]]
    root = d == 0
    columns = [
        pa.array(np.full(len(d), row["part"], np.int32)),
        pa.array(np.full(len(d), row["block"], np.int32)),
        pa.array((a != 0).astype(np.int8)),
        pa.array(d),
        pa.array(keys, pa.binary()),
        pa.array(parents, pa.binary()),
        pa.array((pl != 0).astype(np.int8), mask=~parent_open | root),
        pa.array(least_id.least(a, b)),
        pa.array(parent, mask=parent_open | root),
        pa.array(summed(counts)),
        pa.array(children),
        pa.array(summed(leaf.astype(np.int64))),
        pa.array(summed(counts * total)),
        pa.array(own_bytes),
        pa.array(above),
        pa.array(ends, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=PARTS)


def _outer_lcps(blocks: DataFrame) -> dict[int, tuple[int, int]]:
    """For each range partition the LCPs with its neighbours, -1 where there is none; two rows of each are read."""
    rows = blocks.filter("begins OR closes").select("part", "begins", "closes", "first_path", "last_path").collect()
    first = {r.part: bytes(r.first_path) for r in rows if r.begins}
    last = {r.part: bytes(r.last_path) for r in rows if r.closes}
    parts = sorted(first)
    between = [-1, *(shared_turns(last[p], first[q]) for p, q in zip(parts, parts[1:], strict=False)), -1]
    return {p: (between[i], between[i + 1]) for i, p in enumerate(parts)}


def prefix_nodes(rebuilt: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``(conv_id, turns)``, see :func:`sequences`.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes below or at it), ``saved_tokens`` (over the subtree, all
    but one copy of each node's last text, in bytes) and ``ends_sha256`` (of the ids of the conversations
    that end there, in ascending order, joined by commas). Ids must be unique. A conversation without
    turns ends at the root; with no conversation at all there is no node. A conversation's digests, 20
    bytes a turn, are one row; its texts are not looked at. The result reads a written table, which
    stays in the shared folder.
    """
    spark, paths = rebuilt.sparkSession, []

    def keep(df: DataFrame, label: str) -> DataFrame:
        table, path = write_table(df, label)
        paths.append(path)
        return table

    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rebuilt = keep(
        rebuilt.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("bytes")).withColumn(
            "key", F.unhex(F.md5("path"))
        ),
        "rebuilt",
    )
    # members of equal sequences in order of their ids: dealt out by range, so a hot one is spread too
    ids = rebuilt.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = ids.mapInArrow(_members, "key binary, conv_id bigint, n bigint, ids string")
    chunks = chunks.repartition("key").sortWithinPartitions("key", "conv_id")
    ends = chunks.mapInArrow(_ends, "key binary, conv_id bigint, n bigint, ends string")
    distinct = keep(
        rebuilt.select("conv_id", "path", "bytes").join(ends.select("conv_id", "n", "ends").hint("merge"), "conv_id"),
        "distinct",
    )
    ordered = distinct.select("path", "bytes", "n", "conv_id", "ends").repartitionByRange("path").sortWithinPartitions("path")
    blocks = keep(ordered.mapInArrow(_blocks, BLOCK_TYPE), "blocks")
    outer = _outer_lcps(blocks)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                before, after = outer[row["part"]]
                if not row["begins"]:
                    before = row["lcp"][0]
                if not row["closes"]:
                    after = row["next_lcp"]
                yield block_nodes(row, before, after)

    parts = keep(blocks.mapInArrow(nodes, PART_TYPE), "parts")
    whole, open_ = parts.filter("key IS NULL"), parts.filter("key IS NOT NULL")
    merged = keep(
        open_.groupBy("key").agg(
            F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "all_bytes", "own_bytes")),
            F.max("bytes_above").alias("bytes_above"), F.max("ends").alias("ends"),
        ),
        "merged",
    )
    names = merged.select(F.col("key").alias("name"), F.col("conv_id").alias("least"))
    # what a block's open nodes turned out to be, found by block, depth and side: no key of this join is hot
    seen = open_.select("part", "block", F.col("depth").alias("up"), F.col("side").alias("parent_side"), "key")
    seen = seen.join(names.hint("merge"), seen["key"] == F.col("name")).drop("key", "name")
    below = whole.filter("parent_side IS NOT NULL").withColumn("up", F.col("depth") - 1)
    below = below.join(seen.hint("merge"), ["part", "block", "up", "parent_side"]).withColumn("parent_conv_id", F.col("least"))
    at_ends = merged.join(names.hint("merge"), F.col("parent_key") == F.col("name"), "left")
    at_ends = at_ends.withColumn("parent_conv_id", F.col("least"))
    every = _finished(whole.filter("parent_side IS NULL")).unionByName(_finished(below)).unionByName(_finished(at_ends))
    result = write_and_read(every, "trie")
    for p in paths:
        remove(spark, p)
    return result


def _finished(nodes: DataFrame) -> DataFrame:
    saved: Column = F.col("all_bytes") - F.col("n_convs") * F.col("bytes_above") - F.col("own_bytes")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        saved.alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )
