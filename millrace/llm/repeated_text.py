"""Removal of text that repeats an earlier text over 100 bytes or more, by sorted suffixes.

A byte goes if a string of SPAN bytes that covers it also starts earlier: in a document with a smaller
id, or further ahead in the same one. Equal strings are found in sorted order, but not all suffixes are
sorted.

1. *Anchors.* Every window of SPAN bytes names the place in it whose GRAM bytes hash lowest. Equal windows
   name the same place, so they meet under its hash, and neighbouring windows mostly share an anchor: a
   stretch of windows with one anchor is one row, about one for 35 bytes.
2. *Equal stretches.* Of stretches that agree in anchor, content and extent the first stays; all windows of
   the others are repeats. This is decided first among the rows of an Arrow batch, then in the
   order of anchor and content, dealt out by range, so that a passage on a third of all pages is no
   hot key. What is alone with its anchor is no repeat, and is not looked at again.
3. *Suffixes.* Stretches that share an anchor but differ, as at the ends of a common passage, fetch their
   bytes. The suffixes that begin at the anchors, and the reversed prefixes that end there, are put in
   order by deep-shallow sorting (:mod:`millrace.llm.deep_shallow`). Two windows at the same distance from
   their anchors are equal if they agree to the right and to the left, that is if no LCP between them in
   either order is too short: running numbers over the LCP arrays tell the classes, and the first window
   of a class stays. An anchor with more than GROUP stretches is first split by the bytes that all windows
   of a part of its range contain, again and again with smaller parts; at single windows
   equality is left.
4. The covered places come back to the documents by id, are merged, and cut out.

Hashes are 64 bits wide; equal stretches are known by two of them, of the anchor and of the content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.columns import as_row, of_row, text_or_empty
from millrace.llm.deep_shallow import padded, shared_prefixes, suffix_order
from millrace.plans.scratch import remove, write_and_read, write_table

#: Bytes of a repeat, of an anchor's hash, and places of a window from which it is chosen.
SPAN, GRAM = 100, 32
PLACES = SPAN - GRAM + 1
#: Window starts that are worked on at once.
SLICE = 1 << 17
LOCAL = 18
#: Stretches of an anchor that are sorted in one piece, and stretches sorted together.
GROUP, TOGETHER = 2048, 16_384

MASK = (1 << 64) - 1
ANCHOR_TYPE = "anchor bigint, content bigint, doc bigint, start int, n int, r int"
#: Stands in ``r``, else the distance from a stretch's first window to its anchor, where all windows are repeats.
COVERED = -1


def _odd(seed: int) -> int:
    z = (seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    return (z ^ (z >> 27)) | 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_odd(5))
    return x ^ (x >> np.uint64(29))


class Anchors:
    """The stretches of all documents of a buffer."""

    def __init__(self):
        base, size = _odd(1), SLICE + SPAN
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        back = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        with np.errstate(over="ignore"):
            self.power, self.inverse = np.cumprod(steps), np.cumprod(back)
        self.byte = np.array([_odd(100 + b) for b in range(256)], np.uint64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """Arrays of anchor hash, content hash, document number, start, windows and r (first window's
        distance to the anchor) of the documents ``data[offsets[i]:offsets[i + 1]]``."""
        found = [self._slice(data, offsets, x) for x in range(0, max(0, len(data) - SPAN + 1), SLICE)]
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))

    def _slice(self, data: np.ndarray, offsets: np.ndarray, x: int):
        b = data[x : x + SLICE + SPAN - 1]
        windows = len(b) - SPAN + 1
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.byte[b] * self.power[: len(b)])))
            gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * self.inverse[: len(b) - GRAM + 1])
            low = (gram >> np.uint64(LOCAL) << np.uint64(LOCAL)) | np.arange(len(gram), dtype=np.uint64)
            width = 1
            while 2 * width <= PLACES:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            low = np.minimum(low[:windows], low[PLACES - width : PLACES - width + windows])
            at = (low & np.uint64((1 << LOCAL) - 1)).astype(np.int64)
            # windows that reach over the end of a document are none
            first, last = np.searchsorted(offsets, (x, x + len(b)), "right")
            ends = offsets[first:last] - x
            over = np.zeros(windows + 1, np.int32)
            np.add.at(over, np.clip(ends - SPAN + 1, 0, windows), 1)
            np.add.at(over, np.clip(ends, 0, windows), -1)
            valid = np.cumsum(over[:-1]) == 0
            new = np.ones(windows, bool)
            new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
            start = np.flatnonzero(new & valid)
            breaks = np.flatnonzero(new | ~valid)
            after = np.append(breaks, windows)[np.searchsorted(breaks, start, "right")]
            n, anchor = after - start, at[start]
            r = anchor - start
            content = (sums[after + SPAN - 1] - sums[start]) * self.inverse[start]
            content = _mixed(content ^ ((n * 256 + r).astype(np.uint64) * np.uint64(_odd(7))))
        doc = np.searchsorted(offsets, start + x, "right") - 1
        return gram[anchor].view(np.int64), content.view(np.int64), doc, start + x - offsets[doc], n, r


def _runs(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered windows (sorted) with neighbouring stretches made one."""
    if not len(doc):
        return doc, start, n
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.add.reduceat(n, first)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text as bytes) to stretches; what repeats within a batch comes out as covered at once."""
    anchors = Anchors()
    for batch in batches:
        keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        large = pa.types.is_large_binary(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        anchor, content, doc, start, n, r = anchors(data, offsets - offsets[0])
        in_order = np.lexsort((start, keys[doc], content, anchor))
        anchor, content, start, n, r = (a[in_order] for a in (anchor, content, start, n, r))
        doc = keys[doc[in_order]]
        again = np.zeros(len(doc), bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
        by_place = np.flatnonzero(again)[np.lexsort((start[again], doc[again]))]
        c_doc, c_start, c_n = _runs(doc[by_place], start[by_place], n[by_place])
        spread = _mixed((c_doc * 0x10001 + c_start).astype(np.uint64)).view(np.int64)  # any partition will do
        columns = [
            np.concatenate((anchor[~again], spread)), np.concatenate((content[~again], spread)),
            np.concatenate((doc[~again], c_doc)), np.concatenate((start[~again], c_start)),
            np.concatenate((n[~again], c_n)), np.concatenate((r[~again], np.full(len(c_doc), COVERED))),
        ]
        yield _rows(columns)


def _rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.int32()] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, types, strict=True)],
        ["anchor", "content", "doc", "start", "n", "r"],
    )


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, content, doc, start: repeats come out as covered, and the first of each content
    as it is if its anchor has several, or lies at an end of the partition and may have more beyond it."""
    last = None  # anchor and content of the last row
    held = None  # the only content's first row of the last anchor, while more may come

    def one(row: list) -> pa.RecordBatch:
        return _rows([np.array([v]) for v in row])

    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        covered = rows[5] == COVERED
        if covered.any():
            yield _rows([c[covered] for c in rows])
            rows = [c[~covered] for c in rows]
        anchor, content = rows[0], rows[1]
        if not len(anchor):
            continue
        same_anchor, same_content = np.zeros(len(anchor), bool), np.zeros(len(anchor), bool)
        same_anchor[1:] = anchor[1:] == anchor[:-1]
        same_content[1:] = content[1:] == content[:-1]
        if last is not None:
            same_anchor[0], same_content[0] = anchor[0] == last[0], content[0] == last[1]
        again = same_anchor & same_content
        if again.any():
            yield _rows([c[again] for c in rows[:5]] + [np.full(int(again.sum()), COVERED)])
        first = [c[~again] for c in rows]
        begins = ~same_anchor[~again]
        if len(begins):
            run = np.cumsum(begins)  # 0: the anchor before this batch goes on
            several = (run == 0) | (np.bincount(run)[run] > 1)
            if last is None:
                several[0] = True
            if held is not None and run[0] == 0:
                yield one(held)
            held = None if several[-1] else [c[-1] for c in first]
            yield _rows([c[several] for c in first])
        last = anchor[-1], content[-1]
    if held is not None:
        yield one(held)


def covered_windows(
    key: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, r: np.ndarray, texts: list[bytes]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole groups of stretches: (doc, start, windows) of the windows that an earlier one equals."""
    by_place = np.lexsort((start + r, doc))  # in order of document and anchor: the first of a class stays
    _, group = np.unique(key[by_place], return_inverse=True)
    doc, start, n, r = doc[by_place], start[by_place], n[by_place], r[by_place]
    texts = [texts[i] for i in by_place]
    rights = [t[k:] for t, k in zip(texts, r.tolist(), strict=True)]
    lefts = [t[:k][::-1] for t, k in zip(texts, r.tolist(), strict=True)]
    classes = []
    for strings in (rights, lefts):
        rows = padded(strings, 104)
        order = suffix_order(strings, group, rows)
        lcp = shared_prefixes(rows, np.array([len(s) for s in strings]), group, order)
        classes.append((order, lcp))
    m, least = len(doc), r - n + 1
    covered = np.zeros((m, PLACES + 1), bool)

    def numbers(side: int, depth: int) -> np.ndarray:
        order, lcp = classes[side]
        out = np.empty(m, np.int64)
        out[order] = np.cumsum(lcp < depth)
        return out

    for distance in range(PLACES):
        rows = np.flatnonzero((least <= distance) & (distance <= r))
        if len(rows) > 1:
            same = numbers(0, SPAN - distance)[rows] * (m + 1) + numbers(1, distance)[rows]
            firsts = np.unique(same, return_index=True)[1]
            covered[rows, distance] = True
            covered[rows[firsts], distance] = False
    # windows of a stretch run backwards in distance
    edge = np.diff(covered.astype(np.int8), axis=1, prepend=0)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return doc[row], (start + r)[row] - high + 1, high - low


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; whole groups are sorted together, about TOGETHER rows at a time."""
    held: pa.Table | None = None

    def out(table: pa.Table) -> pa.RecordBatch:
        columns = [table.column(c).to_numpy() for c in ("key", "doc", "start", "n", "r")]
        doc, start, n = covered_windows(
            columns[0], columns[1], *(c.astype(np.int64) for c in columns[2:]), table.column("text").to_pylist()
        )
        zero = np.zeros(len(doc), np.int64)
        return _rows([zero, zero, doc, start, n, np.full(len(doc), COVERED)])

    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = pa.Table.from_batches([batch.slice(at, TOGETHER)])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows < TOGETHER:
                continue
            key = held.column("key").to_numpy()
            whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if whole:
                yield out(held.slice(0, whole))
                held = held.slice(whole)
    if held is not None and held.num_rows:
        yield out(held)


PIECE = ["key", "doc", "start", "n", "r", "text"]


def _split(pieces: DataFrame, size: int) -> DataFrame:
    """Stretches cut where their distance to the anchor is a multiple of ``size``; the key takes up the bytes
    that all windows of such a part contain."""
    cells = pieces.withColumn(
        "cell", F.explode(F.sequence(F.floor((F.col("r") - F.col("n") + 1) / size), F.floor(F.col("r") / size)))
    )
    top = F.least(F.col("r"), F.col("cell") * size + size - 1).cast("int")
    bottom = F.greatest(F.col("r") - F.col("n") + 1, F.col("cell") * size).cast("int")
    cut = cells.select("key", "cell", "doc", "start", "r", "text", top.alias("top"), bottom.alias("bottom"))
    ahead = F.col("r") - F.col("top")
    n = F.col("top") - F.col("bottom") + 1
    cut = cut.select(
        "key", "cell", "doc", (F.col("start") + ahead).alias("start"), n.cast("int").alias("n"),
        F.col("top").alias("r"), F.substring("text", ahead + 1, n + SPAN - 1).alias("text"),
    )
    core = F.substring("text", (F.col("r") - F.col("cell") * size + 1).cast("int"), F.lit(SPAN + 1 - size))
    return cut.select(F.xxhash64("key", "cell", core).alias("key"), *PIECE[1:])


def repeats(docs: DataFrame) -> DataFrame:
    """``doc``, ``start``, ``n``: runs of windows that also start earlier, of ``docs`` (doc bigint, bytes)."""
    spark, paths = docs.sparkSession, []

    def keep(df: DataFrame, label: str) -> DataFrame:
        table, path = write_table(df, label)
        paths.append(path)
        return table

    stretches = docs.select("doc", "bytes").mapInArrow(_stretches, ANCHOR_TYPE)
    sorted_ = stretches.repartitionByRange("anchor", "content").sortWithinPartitions("anchor", "content", "doc", "start")
    judged = keep(sorted_.mapInArrow(_judged, ANCHOR_TYPE), "stretches")
    done = [judged.filter(F.col("r") == COVERED).select("doc", "start", "n")]
    open_ = judged.filter(F.col("r") != COVERED)
    sizes = open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    sizes = keep(sizes, "anchors")
    wanted = (
        open_.join(sizes.hint("merge"), "anchor")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("anchor", "members", "start", "n", "r")).alias("places"))
    )
    found = docs.join(wanted.hint("merge"), "doc").select("doc", "bytes", F.explode("places").alias("p"))
    pieces = found.select(
        F.col("p.anchor").alias("key"), "doc", "p.start", "p.n", "p.r",
        F.substring("bytes", F.col("p.start") + 1, F.col("p.n") + SPAN - 1).alias("text"), "p.members",
    )
    hot = sizes.filter(F.col("members") > GROUP)
    if hot.isEmpty():
        done.append(_by_sorting(pieces))
    else:
        pieces = keep(pieces, "pieces")
        done.append(_by_sorting(pieces.filter(F.col("members") <= GROUP)))
        left, size = pieces.filter(F.col("members") > GROUP).select(*PIECE), 64
        while size and not left.isEmpty():
            parts = keep(_split(left, size), "parts")
            same = ["key", "n", "r", "text"]
            firsts = parts.groupBy(*same).agg(F.min(F.struct("doc", "start")).alias("first"))
            firsts = keep(firsts, "firsts")
            known = firsts.select(*same, F.col("first").alias("earliest"))
            others = parts.join(known.hint("merge"), same).filter(F.struct("doc", "start") != F.col("earliest"))
            done.append(keep(others.select("doc", "start", "n"), "covered"))
            members = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
            members = keep(members, "members")
            apart = firsts.select("key", "first.doc", "first.start", "n", "r", "text")
            apart = keep(apart.join(members.hint("merge"), "key"), "apart")
            done.append(_by_sorting(apart.filter(F.col("members") <= GROUP)))
            left, size = apart.filter(F.col("members") > GROUP).select(*PIECE), size // 2
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    runs = result.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs"))
    result = write_and_read(runs, "repeats")
    for path in paths:
        remove(spark, path)
    return result


def _by_sorting(pieces: DataFrame) -> DataFrame:
    grouped = pieces.select(*PIECE).repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(_sorted_groups, ANCHOR_TYPE).select("doc", "start", "n")


CUT = T.StructType(
    [
        T.StructField("kept", T.BinaryType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def _cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """Texts without the bytes under their runs of windows; null where there are none."""
    out = []
    for text, places in zip(texts.to_pylist(), runs.to_pylist(), strict=True):
        if text is None:
            out.append(None)
            continue
        spans: list[list[int]] = []
        for p in places:
            start, end = p["start"], p["start"] + p["n"] + SPAN - 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(end, spans[-1][1])
            else:
                spans.append([start, end])
        kept, at = [], 0
        for start, end in spans:
            kept.append(text[at:start])
            at = end
        kept.append(text[at:])
        out.append(
            {
                "kept": b"".join(kept),
                "n_removed": sum(e - s for s, e in spans),
                "n_spans": len(spans),
                "spans": [{"start": s, "end": e} for s, e in spans],
            }
        )
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = pa.struct([("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", spans_type)])
    return pa.array(out, kind)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``kept`` (the remaining bytes, UTF-8 as they were), ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal runs of removed bytes) and ``spans`` (start and end of each, from 0).

    Documents come in order of their ids, null first; documents that share an id in order of a digest
    of their texts. Of repeated rows one comes before the others, which then are removed whole if they are
    long enough. A null text counts as empty. An empty table gives an empty result. Columns named like the
    results are replaced, all others may have any name. The result reads a written table of the covered
    places, which stays in the shared folder. A document and its places are one row.
    """
    results = {text_col.lower(), "kept", "n_bytes", "n_removed", "n_spans", "spans"}
    others = [c for c in docs.columns if c.lower() not in results]
    picked = docs.select(
        as_row(others), F.col(id_col).alias("doc"), text_or_empty(F.col(text_col)).cast("binary").alias("bytes")
    )
    whole = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    counts = docs.agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("known"), F.countDistinct(id_col).alias("ids")).first()
    if whole and counts["n"] == counts["known"] == counts["ids"]:
        numbered = picked.withColumn("doc", F.col("doc").cast("long"))
    else:
        digest = F.sha2("bytes", 256)
        in_order = picked.withColumn("digest", digest).repartitionByRange("doc", "digest").sortWithinPartitions("doc", "digest")
        numbered = write_and_read(in_order.select("row", F.monotonically_increasing_id().alias("doc"), "bytes"), "numbered")
    covered = repeats(numbered)
    joined = numbered.join(covered.hint("merge"), "doc", "left")
    has = F.col("runs").isNotNull()
    cut = F.arrow_udf(_cut, CUT)(F.when(has, F.col("bytes")), F.col("runs"))
    done = joined.select("row", "bytes", cut.alias("cut"))
    none = F.array().cast(CUT["spans"].dataType)
    return done.select(
        *of_row(others),
        F.coalesce("cut.kept", "bytes").alias("kept"),
        F.octet_length("bytes").cast("long").alias("n_bytes"),
        F.coalesce("cut.n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("cut.n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("cut.spans", none).alias("spans"),
    )
