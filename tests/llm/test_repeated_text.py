"""Removal of repeated text, and its sorting, against versions by brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import deep_shallow, queries, repeated_text

SPAN = 100


def brute(texts):
    """Texts as bytes, in order: (n_bytes, n_removed, n_spans, kept) of each."""
    seen, out = set(), []
    for text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - SPAN + 1):
            window = text[i : i + SPAN]
            if window in seen:
                gone[i : i + SPAN] = b"\1" * SPAN
            else:
                seen.add(window)
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(text), sum(gone), spans, kept))
    return out


def corpus():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)] + ["é", "日本", "\n"]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    base, passage = prose(120), prose(30)
    texts = [None, "", "short", "a" * 99, "a" * 100, "a" * 101, "a" * 400, "ab" * 300, base, base, base + "x", "\0" * 150, "\0" * 120 + "x"]
    texts += [prose(rng.randint(1, 20)) + passage + prose(rng.randint(1, 20)) for _ in range(40)]
    for _ in range(40):  # near copies
        copy = base.split(" ")
        for k in rng.sample(range(len(copy)), rng.randint(1, 6)):
            copy[k] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [prose(60) for _ in range(20)] + [passage * 3, base[50:300] + base[40:350], prose(3) + "z" * 99 + prose(3), "z" * 99]
    return texts


def check(result, rows, tie):
    """``rows`` (id, text) in the order in which documents come."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r)))
    encoded = [(r[1] or "").encode() for r in ordered]
    want = Counter((r[0], *w) for r, w in zip(ordered, brute(encoded), strict=True))
    got = result.collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    for r in got:
        assert len(r.spans) == r.n_spans and sum(s.end - s.start for s in r.spans) == r.n_removed


@pytest.mark.parametrize("group, cells", [(2048, "whole"), (3, "split")])
def test_repeats_by_brute_force(spark, monkeypatch, group, cells):
    monkeypatch.setattr(repeated_text, "GROUP", group)
    texts = corpus()
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, start string, row string").repartition(6)
    out = repeated_text.remove_repeats(docs)
    check(out, rows, lambda r: 0)
    assert out.select("start", "row").distinct().collect() == [("x", "y")]
    assert repeated_text.remove_repeats(docs.limit(0)).count() == 0


def test_equal_and_missing_ids(spark):
    texts = corpus()[8:30]
    rows = [(i % 7 if i % 5 else None, t) for i, t in enumerate(texts)] + [(3, texts[0]), (3, texts[0]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(repeated_text.remove_repeats(docs), rows, lambda r: hashlib.sha256((r[1] or "").encode()).hexdigest())


def test_slices_do_not_matter(monkeypatch):
    """Repeats of one long text, cut into slices anywhere."""
    rng = random.Random(8)
    text = bytes(rng.choices(b"abcd", k=150)) * 3 + bytes(rng.choices(b"ab", k=2000))
    data = np.frombuffer(text, np.uint8)
    stretches = {}
    for size in (64, 150, 1000, 1 << 17):
        monkeypatch.setattr(repeated_text, "SLICE", size)
        anchor, _, doc, start, n, r = repeated_text.Anchors()(data, np.array([0, len(text)]))
        places = {}
        for a, s, m, k in zip(anchor, start, n, r, strict=True):
            for i in range(m):
                places[s + i] = (a, s + k)
        assert sorted(places) == list(range(len(text) - SPAN + 1)) and not doc.any()
        stretches[size] = places
    assert all(v == stretches[64] for v in stretches.values())


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    parts = [bytes(rng.choices(b"xyz ", k=rng.randint(0, 400))) for _ in range(40)]
    data = [rng.choice(parts) + rng.choice(parts) for _ in range(60)]
    offsets = np.cumsum([0, *map(len, data)])
    anchor, _, doc, start, n, r = repeated_text.Anchors()(np.frombuffer(b"".join(data), np.uint8), offsets)
    seen = {}
    covered = 0
    for a, d, s, m, k in zip(anchor, doc, start, n, r, strict=True):
        for i in range(m):
            window = data[d][s + i : s + i + SPAN]
            assert len(window) == SPAN
            assert seen.setdefault(window, (a, k - i)) == (a, k - i)
            covered += 1
    assert covered == sum(max(0, len(t) - SPAN + 1) for t in data)


def test_deep_shallow_order():
    rng = random.Random(6)
    stems = [bytes(rng.choices(b"\0ab", k=rng.randint(0, 90))) for _ in range(12)]
    strings = [(rng.choice(stems) + bytes(rng.choices(b"\0ab", k=rng.randint(0, 10))))[:100] for _ in range(3000)]
    groups = np.array([rng.randint(0, 5) for _ in strings])
    rows = deep_shallow.padded(strings, 104)
    order = deep_shallow.suffix_order(strings, groups, rows)
    got = [(groups[i], strings[i]) for i in order]
    assert got == sorted(zip(groups.tolist(), strings, strict=True))
    lcp = deep_shallow.shared_prefixes(rows, np.array([len(s) for s in strings]), groups, order)
    for k in range(1, len(got)):
        a, b = got[k - 1], got[k]
        n = 0
        while a[0] == b[0] and n < min(len(a[1]), len(b[1])) and a[1][n] == b[1][n]:
            n += 1
        assert lcp[k] == (n if a[0] == b[0] else -1)
    assert len(deep_shallow.suffix_order([], np.zeros(0, np.int64), deep_shallow.padded([], 104))) == 0


def test_op13_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    found = brute([(r.text or "").encode() for r in rows])
    want = {r.doc_id: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for r, w in zip(rows, found, strict=True)}
    got = queries.op13_suffix_array_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert len(got) == len(rows)
