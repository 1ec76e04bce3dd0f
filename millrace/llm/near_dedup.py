"""Near duplicates by MinHash with tensored banding, verified on whole shingle sets.

Two documents are linked if their sets of distinct five-word shingles have a similarity of 0.75 or more.

* A set is hashed by 2 x HALVES minimum hashes, two of which make a half key. A table's key combines
  two half keys, so HALVES half keys serve HALVES (HALVES - 1) / 2 tables: 16 serve 120, with 32
  hashes instead of 480. A pair at similarity s is met unless fewer than two half keys agree: at the
  threshold it is missed with probability 4e-5, at 0.8 with 5e-6.
* A table can bring two sets together only if both half keys occur elsewhere. So half keys that occur
  once are dropped first, and only sets with two others form table keys at all.
* A shingle that only one of those sets has lies in no intersection. Counting them bounds every
  similarity from above, exactly: sets that cannot reach the threshold with anything leave.
* In each bucket the set with the smallest share of such shingles is the center; the others are
  verified against it, and links merge into components. Sets of buckets whose members still belong to
  several components are searched by an exact prefix filter on their rarest shingles, with the sizes
  that the place of a shingle allows in the join key, and what that finds across components is
  verified. No bucket is capped or skipped; pairs are formed only where that bound allows a link.

Equal sets are one node from the start. Sets, links and components stay in distributed tables; each
step that is used more than once is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import remove, write_and_read, write_table

WORDS, HALVES = 5, 16
#: Similarity of a link as a fraction: 3/4.
LEAST, OF = 3, 4
MASK = (1 << 64) - 1
#: Classes of set sizes: exact ones up to this number, then by steps of this part.
SIZES = 64


def _numbers(n: int, seed: int):
    """Odd 64-bit numbers from a fixed generator."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        out.append((z ^ (z >> 31)) | 1)
    return out


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles, and their minimum hashes."""

    def __init__(self):
        import numpy as np

        self.np = np
        self.byte = np.array(_numbers(256, 11), np.uint64)
        self.powers = np.ones(1, np.uint64)
        self.place = np.array(_numbers(WORDS, 13), np.uint64)
        self.factor = np.array(_numbers(2 * HALVES, 17), np.uint64)[:, None]
        self.offset = np.array(_numbers(2 * HALVES, 19), np.uint64)[:, None]
        self.pair = np.array(_numbers(2, 23), np.uint64)
        self.gap = np.zeros(256, bool)
        self.gap[[9, 10, 11, 12, 13, 32]] = True

    def mixed(self, x):
        np = self.np
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    def words(self, text: str):
        """A hash per word of the text in lower case (A to Z only), computed over all bytes at once."""
        np = self.np
        b = np.frombuffer(text.encode().lower(), np.uint8)
        gap = self.gap[b]
        inside = ~gap
        begins = inside.copy()
        begins[1:] &= gap[:-1]
        letters = b[inside]
        if not len(letters):
            return np.zeros(0, np.uint64)
        starts = np.flatnonzero(begins[inside])
        lengths = np.diff(np.append(starts, len(letters)))
        if lengths.max() > len(self.powers):
            steps = np.full(int(lengths.max()) * 2, 0x9FB21C651E98DF25, np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps)
        place = np.arange(len(letters)) - np.repeat(starts, lengths)
        sums = np.add.reduceat(self.byte[letters] * self.powers[place], starts)
        return self.mixed(sums + lengths.astype(np.uint64))

    def __call__(self, text: str | None):
        np = self.np
        words = self.words(text) if text else np.zeros(0, np.uint64)
        if not len(words):
            return words
        n = max(1, len(words) - WORDS + 1)
        words = np.append(words, np.zeros(max(0, WORDS - len(words)), np.uint64))
        total = np.zeros(n, np.uint64)
        for i in range(WORDS):
            total += words[i : i + n] * self.place[i]
        return np.unique(self.mixed(total))

    def halves(self, shingles):
        """The half keys, each from two minimum hashes; long sets are gone through in parts."""
        np = self.np
        least = np.full(2 * HALVES, MASK, np.uint64)
        for at in range(0, len(shingles), 4096):
            hashed = self.mixed((shingles[at : at + 4096] ^ self.offset) * self.factor)
            np.minimum(least, hashed.min(axis=1), out=least)
        return self.mixed(least[0::2] * self.pair[0] + least[1::2] * self.pair[1])


def signatures(text: Column) -> Column:
    """Struct of ``n`` (set size), ``digest`` (of the set) and ``halves`` (none for an empty set)."""

    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from hashlib import blake2b

        import numpy as np

        shingler = Shingler()
        for batch in batches:
            sizes, digests, keys = [], [], []
            for value in batch:
                shingles = shingler(value.as_py())
                sizes.append(len(shingles))
                digests.append(blake2b(shingles.tobytes(), digest_size=16).digest())
                keys.append(shingler.halves(shingles) if len(shingles) else shingles)
            ends = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            yield pa.StructArray.from_arrays(
                [
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                ["n", "digest", "halves"],
            )

    return F.arrow_udf(sign, "struct<n:bigint,digest:binary,halves:array<bigint>>")(text)


def shingle_sets(text: Column) -> Column:
    """The set itself, as sorted 64-bit hashes of its shingles."""

    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        shingler = Shingler()
        for batch in batches:
            sets = [shingler(value.as_py()) for value in batch]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return F.arrow_udf(make, "array<bigint>")(text)


def _within_reach(n: Column, m: Column, common: Column) -> Column:
    """Whether sets of n and m elements with at most ``common`` in common can be linked."""
    return (OF + LEAST) * common >= LEAST * (n + m)


class _Run:
    """Tables of one run; all but the result are deleted at its end."""

    def __init__(self):
        self.paths: list[str] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        table, path = write_table(df, label)
        self.paths.append(path)
        return table

    def end(self, spark) -> None:
        for path in self.paths:
            remove(spark, path)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_shingles``, ``component_id`` and ``kept``.

    ``component_id`` is the smallest id among the documents that links lead to, the row's own
    included; ``kept`` says whether that is the row's id. Texts without words, empty or null ones are
    linked with nothing. Of repeated rows with the component's id exactly one is kept. A null id is no
    smallest id: a component of null ids only has a null id, and one of its rows is kept. An empty
    table gives an empty result. Columns named like the results are replaced. The result is a table
    in the shared folder.
    """
    spark, run = docs.sparkSession, _Run()
    results = {text_col.lower(), "n_shingles", "component_id", "kept"}
    others = [c for c in docs.columns if c.lower() not in results]
    signed = run.keep(
        docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .withColumn("s", signatures(F.col("text")))
        .select("row", "id", "s.*", F.monotonically_increasing_id().alias("number")),
        "signed",
    )
    nodes = run.keep(
        signed.filter("n > 0")
        .groupBy("digest")
        .agg(F.min(F.struct("number", "id", "n", "halves")).alias("one"), F.min("id").alias("least_id"))
        .select("digest", F.col("one.number").alias("node"), "one.id", "one.n", "one.halves", "least_id"),
        "nodes",
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    links = _links(texts, nodes, run)
    stars = connected(links, run)
    merged = (
        nodes.select("digest", "node", "least_id")
        .join(stars, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    merged = run.keep(merged, "members")
    named = run.keep(
        merged.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n_nodes")),
        "components",
    )
    # digests of the sets that any row shares, or that a link leads to; all other rows stand alone
    shared = signed.filter("n > 0").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    found = (
        merged.join(named, "component")
        .join(shared, "digest")
        .filter("n_nodes > 1 OR copies > 1")
        .select("digest", "component", "component_id")
    )
    found = run.keep(found, "found")
    # the row that stays: the least row number among those with the component's id
    labelled = signed.select("row", "id", "n", "number", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    labelled = run.keep(labelled.join(found, "digest", "left"), "labelled")
    first = (
        labelled.filter(F.col("component").isNotNull() & F.col("id").eqNullSafe(F.col("component_id")))
        .groupBy("component")
        .agg(F.min("number").alias("stays"))
    )
    first = run.keep(first, "stays")
    in_group = F.col("component").isNotNull()
    result = labelled.join(first.select(F.col("stays").alias("number"), F.lit(True).alias("stays")), "number", "left").select(
        "row",
        F.col("n").alias("n_shingles"),
        F.when(in_group, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        (~in_group | F.coalesce("stays", F.lit(False))).alias("kept"),
    )
    result = write_and_read(result, "near-groups")
    run.end(spark)
    return result.select(*(F.col(f"row.{c}").alias(c) for c in others), "n_shingles", "component_id", "kept")


def _links(texts: DataFrame, nodes: DataFrame, run: _Run) -> DataFrame:
    """Linked pairs of nodes (a, b) from which all components follow."""
    halves = nodes.select("node", "id", "digest", "n", F.posexplode("halves").alias("i", "half"))
    twice = run.keep(
        halves.groupBy("i", "half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "half-keys"
    )
    shared = run.keep(
        halves.join(twice, ["i", "half"], "left_semi")
        .groupBy("node", "id", "digest", "n")
        .agg(F.sort_array(F.collect_list(F.struct("i", "half"))).alias("halves"))  # at most HALVES
        .filter(F.size("halves") > 1),
        "candidates",
    )
    sets = run.keep(_candidate_sets(texts, shared, run), "sets")
    alone = (
        sets.select("node", F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
        .filter("c = 1")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("alone"))
    )
    common = F.col("n") - F.coalesce("alone", F.lit(0))
    able = shared.join(alone, "node", "left").withColumn("common", common)
    able = able.filter(OF * F.col("common") >= LEAST * F.col("n"))
    pairs = F.flatten(
        F.transform(
            "halves",
            lambda x, k: F.transform(
                F.slice("halves", k + 2, HALVES),
                lambda y: F.xxhash64(x["i"], x["half"], y["i"], y["half"]),
            ),
        )
    )
    table = run.keep(
        able.select(F.explode(pairs).alias("bucket"), "node", "n", "common"), "table-keys"
    )
    center = F.max(F.struct((F.col("common") / F.col("n")).alias("share"), (-F.col("node")).alias("minus"), "n", "common"))
    centers = run.keep(
        table.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("c"), center.alias("center"))
        .filter("c > 1")
        .select("bucket", (-F.col("center.minus")).alias("a"), F.col("center.n").alias("m"), F.col("center.common").alias("most")),
        "centers",
    )
    stars = (
        table.join(centers, "bucket")
        .filter((F.col("a") != F.col("node")) & _within_reach(F.col("n"), F.col("m"), F.least("common", "most")))
        .select("a", F.col("node").alias("b"))
        .distinct()
    )
    found = run.keep(_verified(stars, sets), "links")
    rest = _verified(_unresolved(table, centers, connected(found, run), sets, run), sets)
    return run.keep(found.unionByName(rest), "all-links")


def _candidate_sets(texts: DataFrame, shared: DataFrame, run: _Run) -> DataFrame:
    """``node`` and ``shingles`` of the candidates, made again from their texts.

    Texts are found by id; as ids may be repeated, what counts in the end is the set's digest.
    """
    wanted = shared.select(F.col("id").alias("own"), "digest", "node")
    found = texts.join(wanted.select("own").hint("merge"), F.col("id").eqNullSafe(F.col("own")), "left_semi")
    found = run.keep(found.distinct(), "candidate-texts")  # written, or all texts would be signed again
    again = found.select("text", signatures(F.col("text"))["digest"].alias("digest"))
    made = again.join(wanted, "digest").select("node", shingle_sets(F.col("text")).alias("shingles"))
    return made


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(other, "b")
        .join(one, "a")
        .filter(_within_reach(F.size("x"), F.size("y"), both))
        .select("a", "b")
    )


def _unresolved(table: DataFrame, centers: DataFrame, stars: DataFrame, sets: DataFrame, run: _Run) -> DataFrame:
    """Pairs across components that may be linked, among sets of buckets with several components.

    In each bucket, members that no other member's size lets reach the threshold leave; where the rest
    belongs to several components, its sets are searched by an exact prefix filter: with shingles in
    order of how many of these sets hold them, rarest first, two sets with o shingles in common share
    one of their first n - o + 1. Where the first shingle they share stands bounds the partner's size,
    so sets meet by shingle and classes of both sizes: a family that shares a template too small for a
    link forms no pairs. Pairs are formed where this bound allows a link, or misses it by less than a
    class; a large unlinked family whose members differ in random places at a similarity just below the
    threshold is still compared pair by pair.
    """
    members = table.join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = table.join(centers, "bucket", "left_semi").groupBy("bucket").agg(F.min("n").alias("least"))
    smallest = run.keep(smallest, "smallest")
    alive = run.keep(
        members.join(smallest, "bucket").filter(_within_reach(F.col("n"), F.col("least"), F.col("common"))),
        "alive",
    )
    parts = alive.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q"))
    several = run.keep(parts.filter("p != q").select("bucket"), "several")
    open_ = run.keep(
        alive.join(several, "bucket", "left_semi")
        .groupBy("node")
        .agg(F.min("n").alias("n"), F.min("component").alias("component"), F.min("least").alias("least")),
        "open",
    )
    held = run.keep(open_.join(sets, "node").withColumn("shingle", F.explode("shingles")).drop("shingles"), "held")
    holders = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    ranked = held.join(run.keep(holders, "holders"), "shingle", "left")
    in_order = F.sort_array(F.collect_set(F.struct(F.coalesce("holders", F.lit(1)).alias("holders"), "shingle")))
    # a partner has at least LEAST / OF of the set's size, and the least size met in its buckets
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * LEAST / OF))
    common = F.ceil((F.col("n") + partner) * LEAST / (OF + LEAST))
    first = (
        ranked.groupBy("node", "n", "component", "least")
        .agg(in_order.alias("shingles"))
        .select("node", "n", "component", F.slice("shingles", F.lit(1), (F.col("n") - common + 1).cast("int")).alias("first"))
        .select("node", "n", "component", F.posexplode("first").alias("at", "x"))
        .filter("x.holders > 1")
        .select("node", F.col("n"), (F.col("n") - F.col("at")).alias("left"), "component", "x.shingle")
    )
    first = run.keep(first, "first-shingles")
    # if it is the first they share, no more can be common than what either has from there on: that
    # bounds the partner's size, and the bound goes into the key, by classes of size
    largest = F.floor((OF + LEAST) * F.col("left") / LEAST) - F.col("n")
    sized = first.withColumn("largest", largest).withColumn("class", size_class(F.col("n")))
    up = F.least("largest", F.floor(F.col("n") * OF / LEAST))
    small = sized.filter(F.col("n") <= F.col("largest")).select(
        "shingle", F.col("node").alias("a"), F.col("n").alias("m"), F.col("left").alias("most"),
        F.col("component").alias("own"), F.col("class").alias("low"),
        F.explode(F.sequence("class", size_class(up))).alias("high"),
    )
    down = size_class(F.ceil(F.col("n") * LEAST / OF))
    top = F.least("class", size_class("largest"))
    large = sized.filter(down <= top).select(
        "shingle", "node", "n", "left", "component", F.col("class").alias("high"),
        F.explode(F.sequence(down, top)).alias("low"),
    )
    reach = _within_reach(F.col("n"), F.col("m"), F.least("left", "most"))
    met = small.join(large, ["shingle", "low", "high"]).filter(
        (F.col("m") <= F.col("n")) & (F.col("own") != F.col("component")) & reach
    )
    return met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def size_class(n: Column | str) -> Column:
    """Sizes by their exact number up to SIZES, and by steps of a SIZES-th beyond; never falls as n grows."""
    n = F.col(n) if isinstance(n, str) else n
    beyond = SIZES + F.floor(SIZES * F.log(F.greatest(n, F.lit(SIZES)) / SIZES))
    return F.when(n <= SIZES, n).otherwise(beyond).cast("long")


def connected(links: DataFrame, run: _Run) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all nodes but the smallest ones themselves.

    Alternates two steps on the pairs until they no longer change, a number of rounds that grows with
    the logarithm of the longest chain: every node links its larger neighbours to its smallest one,
    then its smaller ones and itself. What remains is a star around each component's smallest node.
    """
    pairs = run.keep(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(),
        "pairs",
    )
    before = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = run.keep(least.select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = run.keep(large.filter("u != v").distinct(), "large-star")
        least = run.keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        pairs = run.keep(small.select(ends.alias("e")).select("e.*").filter("u != v").distinct(), "small-star")
