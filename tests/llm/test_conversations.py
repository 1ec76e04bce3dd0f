"""The conversation operators against versions by brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from millrace.llm import prefix_trie, queries, structure_repair

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string, present string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    rng, rows = random.Random(5), []
    for conv in range(140):
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 9, 12])):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"])
            text = rng.choice(["a.", "a", "b!", None, "", " \n", "é?", "x y", f"own {conv}."])
            rows.append((conv, rng.choice([turn, turn, None, turn + 3]), role, text))
    rows += [(conv, t, "user", f"same {t}.") for conv in range(500, 560) for t in range(4)]
    rows += [(-7, 0, "user", "hi."), (-7, 0, "user", "hi."), (600, None, None, None), (None, 0, "user", "a.")]
    rows += [(700, t, ("user", "assistant")[t % 2], "long. " * 50) for t in range(700)]
    return rows


def in_order(rows, second):
    by_conv = defaultdict(list)
    for row in rows:
        if row[0] is not None:
            by_conv[row[0]].append(row)
    return {c: sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, *second(r))) for c, v in by_conv.items()}


def turn_digest(row):
    role, text = row[2] or "", row[3] or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def trie(sequences):
    """conv_id: turns, by a dictionary of prefixes."""
    members, leafs = defaultdict(list), []
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, convs in members.items():
        inside = [q for q in members if q[: len(p)] == p] if len(members) < 6000 else None
        leaves = sum(not children[q] for q in inside)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in inside if q)
        ends = sorted(c for c in convs if len(sequences[c]) == len(p))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[p[:-1]]) if p else None
        out.append((min(convs), len(p), parent, len(convs), children[p], leaves, saved, digest))
    return Counter(out)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("block", [1, 3, 8192])
def test_prefix_nodes(spark, odd_rows, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [r for r in odd_rows if r[0] != 700 or (r[1] or 0) < 40]
    ordered = in_order(rows, lambda r: (turn_digest(r),))
    want = {c: tuple((r[2] or "", r[3] or "") for r in v) for c, v in ordered.items()}
    got = prefix_trie.prefix_nodes(prefix_trie.sequences(table(spark, rows).repartition(5)))
    assert Counter(tuple(r[c] for c in NODE) for r in got.collect()) == trie(want)
    assert prefix_trie.prefix_nodes(prefix_trie.sequences(table(spark, rows).limit(0))).count() == 0


def test_turnless_conversations(spark):
    rows = [(1, []), (2, []), (3, [("d" * 32, 5)])]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<digest:string,bytes:int>>")
    got = {r.depth: r for r in prefix_trie.prefix_nodes(df).collect()}
    assert (got[0].conv_id, got[0].n_convs, got[0].n_children, got[0].n_leaves) == (1, 3, 1, 1)
    assert got[0].ends_sha256 == hashlib.sha256(b"1,2").hexdigest() and got[1].parent_conv_id == 1
    alone = prefix_trie.prefix_nodes(df.filter("conv_id < 3")).collect()
    assert [(r.depth, r.n_leaves, r.n_children) for r in alone] == [(0, 1, 0)]


def rebuilt(rows):
    ordered = in_order(rows, lambda r: (turn_digest(r),))
    turns = {c: tuple((r[2] or "", r[3] or "") for r in v) for c, v in ordered.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, ())[:h] + own[h:]
    return out


def test_op11_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    got = queries.op11_prefix_trie(spark, sf_dir)
    assert Counter(tuple(r[c] for c in NODE) for r in got.collect()) == trie(rebuilt(rows))


def test_binary_searches():
    import numpy as np

    rng = random.Random(2)
    for n in (1, 2, 3, 17, 64, 100):
        lcp = np.array([-1, *(rng.randint(0, 4) for _ in range(n - 1))])
        minima = prefix_trie.RangeMinima(lcp)
        for i, d in itertools.product(range(n), range(6)):
            l = r = i
            while l > 0 and lcp[l] >= d:
                l -= 1
            while r + 1 < n and lcp[r + 1] >= d:
                r += 1
            place, depth = np.array([i]), np.array([d])
            assert (minima.left(place, depth)[0], minima.right(place, depth)[0]) == (l, r)
            assert minima.least(np.array([l]), np.array([r]))[0] == lcp[l : r + 1].min()


# --- repair --------------------------------------------------------------------------------------


def faults(rows):
    """Per row: the first fault."""
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+", "", text)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Dijkstra over (cost, audit, rows read, turns out, state); ties by the audit string."""
    kinds, heap, done = faults(rows), [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        steps = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        name = "assistant" if state == "u" else "user"
        heappush(heap, (cost + 2, audit + "I", i, name[0], (*out, (name, ""))))
        if i < len(rows):
            _, _, role, text = rows[i]
            heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if kinds[i] not in ("b", "d"):
                cut = kinds[i] == "t"
                if role[:1] and role[:1] in steps:
                    heappush(heap, (cost + cut, audit + "K", i + 1, role[:1], (*out, (role, text))))
                heappush(heap, (cost + 2 + cut, audit + "R", i + 1, name[0], (*out, (name, text))))
    raise AssertionError


def report(rows):
    kinds = faults(rows)
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = cheapest(rows)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, digest), out


def harmed(rows):
    out, convs = [], set()
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        convs.add(conv)
        fault = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    ordered = in_order(out, lambda r: (r[2], r[3]))
    return {c: ordered.get(c, []) for c in convs}


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reported(df):
    return {r.conv_id: tuple(r[c] for c in REPORT) for r in df.collect()}


@pytest.mark.parametrize("window", [1, 2, 64])
def test_repair(spark, odd_rows, monkeypatch, window):
    monkeypatch.setattr(structure_repair, "WINDOW", window)
    rows = table(spark, odd_rows).repartition(4)
    got = reported(structure_repair.repair_reports(queries.damaged(rows), present=F.col("present")))
    want = {c: report(v) for c, v in harmed(odd_rows).items()}
    assert got == {c: w[0] for c, w in want.items()}
    turns = structure_repair.repaired_turns(queries.damaged(rows), present=F.col("present")).collect()
    out = defaultdict(dict)
    for t in turns:
        out[t.conv_id][t.place] = (t.role, t.text)
    assert {c: [v[k] for k in sorted(v)] for c, v in out.items()} == {c: w[1] for c, w in want.items() if w[1]}
    nothing = reported(structure_repair.repair_reports(rows.limit(0)))
    assert nothing == {}


def test_nulls_count_as_one_space(spark):
    got = reported(structure_repair.repair_reports(table(spark, [(1, None, None, None), (2, 5, None, "a")])))
    assert got[1] == (0, 1, 0, 0, 0, 3, "D", hashlib.sha256(b"").hexdigest())
    assert got[2][:7] == (0, 0, 0, 1, 0, 3, "D")


def test_op12_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    got = reported(queries.op12_structure_repair(spark, sf_dir))
    assert got == {c: report(v)[0] for c, v in harmed(rows).items()}


def test_every_short_conversation():
    """All sequences of up to five kinds of rows, against the search by cost."""
    kinds = [("user", "q."), ("assistant", "q."), ("system", "q."), ("tool", "x"), ("user", "")]
    for n in range(5):
        for picked in itertools.product(kinds, repeat=n):
            rows = [(1, i, role, text and f"{i}{text}") for i, (role, text) in enumerate(picked)]
            out = []
            repair = structure_repair.Repair(lambda role, text, letter: out.append((role, text)))
            for _, turn, role, text in rows:
                repair.row(turn, role, text)
            *_, cost, audit = repair.finish()
            assert ((cost, audit), out) == (cheapest(rows)[:2], cheapest(rows)[2])
