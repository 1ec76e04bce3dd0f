"""The corpus operators against versions by brute force, on odd inputs and on the smallest tables."""

import gzip
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from millrace.llm import bpe, chat, exact_dedup, language_id, line_dedup, near_dedup, packing
from millrace.llm import quality, queries, token_counts, vocabulary, warc
from millrace.llm.memo import Memo

ODD = [
    None, "", " ", "a", "\n\n", "  a  ", "Ab ab AB", "don't!'s !'s x'll", "<|endoftext|>a<|endoftext|> b",
    "\x01's \x7f's \x00a", "日本語 テキスト 🎉🎉 \U000f0000 x", "a" * 5000, "é́ ñ İ ΣΣ 　x y",
    "the cat\nthe cat\nthe dog", "one two three one two three one", "a a a a a a", "[#*$%&|<>] word!",
    "x\r\ny\x0bz\x0c", "word, word. Word", "12.5 3.a's", "\U000c0000x  \U000c0000", "the quick brown fox " * 3000,
    "PEKİ. İ, İ PEKİ peki.", "<|endoftext|>" * 3000, "a<|endoftext|>" * 50 + "b",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with repeated rows, equal ids, a null id, and columns named like results."""
    rng = random.Random(3)
    parts = ["a", "the", "'s", " ", "  ", "\n", "é", "!", "<|endoftext|>", "日", "\t", "T", ".", "#", "word "]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(150)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", -1, "x") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "a", None, None, -1, "x"), (3, "other", "fr", "s1", -1, "x")]
    kind = "doc_id long, text string, lang string, source string, n_tokens long, kept string"
    return spark.createDataFrame(rows, kind).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


def text_of(row):
    return row["text"] or ""


def test_token_pieces_and_packing(odd, empty):
    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    pieces = packing.token_pieces(odd, queries.WORD_BPE, capacity=64)
    want = Counter()
    for row in odd.collect():
        ids = tokenizer.encode(text_of(row), add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 64):
            part = np.array(ids[at : at + 64], "<u4").tobytes()
            want[row["doc_id"], at // 64, at, len(part) // 4, zlib.crc32(part)] += 1
    placed = packing.pack(pieces, ["doc_id", "piece"], capacity=64)
    rows = placed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 64
    sequences = packing.sequences(placed).collect()
    assert {s.sequence_id: len(s.ids) for s in sequences} == ends
    assert packing.pack(packing.token_pieces(empty, queries.WORD_BPE), ["doc_id"]).count() == 0


def test_plan_is_tight():
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 100) for _ in range(3000))
    plan = packing.plan_bins(counts, 100)
    taken, fill = Counter(), Counter()
    for length, first, last, start, per_bin, _ in plan:
        taken[length] += last - first
        for k in range((last - first) // per_bin):
            fill[start + k] += length * per_bin
    assert taken == counts and max(fill.values()) <= 100
    over_half = sum(c for n, c in counts.items() if n > 50)  # no two share a bin
    bound = max(sum(n * c for n, c in counts.items()) / 100, over_half)
    assert len(fill) <= 1.03 * bound + 1


def test_two_documents_replace_the_smallest():
    # greedy 6 + 3 leaves a gap of 1; giving way to 2 + 2 closes it
    plan = packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(row[0] for row in plan if row[3] == 0) == [2, 6]


def test_quality_measures_by_brute_force(odd, empty):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    for row in quality.apply_rules(odd).collect():
        text, m = text_of(row), row["measured"]
        words = word.findall(text)
        windows = list(zip(words, words[1:], words[2:], strict=False))
        often = Counter(windows)
        marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if word.search(x)]
        assert m["n_words"] == len(words)
        assert m["word_chars"] == sum(map(len, words))
        assert m["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert m["n_dup_lines"] == len(lines) - len(set(lines))
        assert m["n_repeat_words"] == len(marked)
        failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
        assert row["base_failed"] == failed
        assert row["kept"] == (not failed and not row["broken"])
    assert quality.apply_rules(empty).count() == 0


def test_quality_filter_is_not_computed_anew(odd):
    assert quality.apply_rules(odd).filter("kept").count() >= 0


def test_exact_groups(spark, odd, empty):
    long = "z" * 70 + "y" * 5000
    more = [(900 + i, t, None, None, -1, "x") for i, t in enumerate([long + "a", long + "b", long + "A", long[:600]])]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema))
    lower = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    groups = defaultdict(list)
    for row in docs.collect():
        groups[text_of(row).translate(lower)].append(row["doc_id"])
    want = Counter()
    for ids in groups.values():
        top = max((i for i in ids if i is not None), default=None)
        want.update((i, top, len(ids)) for i in ids)
    rows = exact_dedup.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_bpe_round_trip(odd, empty):
    tokenizer = Tokenizer.from_file(queries.BYTE_BPE)
    rows = bpe.decode(bpe.encode(odd, queries.BYTE_BPE), queries.BYTE_BPE).collect()
    for row in rows:
        ids = tokenizer.encode(text_of(row), add_special_tokens=False).ids
        assert row["ids"] == ids
        assert row["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)
    assert len(rows) == odd.count()
    assert bpe.encode(empty, queries.BYTE_BPE).count() == 0


def test_decoding_odd_ids(spark):
    rows = [([0, 10**6, -1],), ([],), (None,), ([50256],), ([255],)]
    out = bpe.decode(spark.createDataFrame(rows, "ids array<int>").coalesce(1), queries.BYTE_BPE).collect()
    assert [r.decoded for r in out][:4] == ["!", "", None, "<|endoftext|>"]


def test_cuts_leave_fragments_independent():
    with open(queries.BYTE_BPE, encoding="utf-8") as f:
        cuts = bpe.cut_table(bpe.token_bytes(f.read()))
    assert bpe.fragments(b"one two, three", cuts)[:2] == ["one", " two"]
    assert cuts.sum() > 1000 and not cuts[ord("t") * 256 + ord("h")]


ODD_BITS = [
    "a", "B", "Word", " PEK\u0130", "\u0130", "\u00e9", " \u00c9", "\u00df", "\u1e9e", "\u00b5", "\u00aa", "\u00ba", "\u00b2", "\u03a3",
    ".", ",", "!!", "%", "'s", "'S", "'", "\u2019", "1", "12", " ", "  ", "\n", "\t", "\u0085", "\u00a0", "<|endoftext|>", "<|ENDOFTEXT|>", "<|",
    ")", "-", "\u00ff", "\u0178", "\u017f", "K", "\u0301", " \u00f6", "\u00d7", "\u4e2d", "_", "\U0001f600", "\r", "\ufb01", "\u0149", "'ll",
]


def test_whole_texts_by_words_and_fragments():
    """Encoders of whole texts against the library, on texts of odd parts, in Latin-1 only and in all letters."""
    rnd, made = random.Random(29), []
    for bits in (ODD_BITS, [b for b in ODD_BITS if max(b) < "\u0100"]):
        made += ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 10))) for _ in range(5000)]
    for path, make, given in (
        (queries.WORD_BPE, vocabulary.WordEncoder, str),
        (queries.BYTE_BPE, bpe.FragmentEncoder, str.encode),
    ):
        with open(path, encoding="utf-8") as f:
            encoder = make(f.read())
        tokenizer = Tokenizer.from_file(path)
        for text in made:
            ids = np.frombuffer(encoder.text(given(text)), "<u4").tolist()
            assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_are_merged_apart_only_where_the_vocabulary_leaves_them_whole():
    with open(queries.BYTE_BPE, encoding="utf-8") as f:
        model = f.read()
    assert bpe.FragmentEncoder(model).direct
    lowering = Tokenizer.from_str(model)
    lowering.normalizer = normalizers.Lowercase()
    prefixing = Tokenizer.from_str(model)
    prefixing.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    assert not any(bpe.FragmentEncoder(t.to_str()).direct for t in (lowering, prefixing))


def test_a_memory_forgets_without_a_change_of_results():
    asked = []
    memo = Memo(lambda keys: asked.extend(keys) or [k * 2 for k in keys], limit=3)
    for at in range(40):
        keys = [f"k{(at * i) % 9}" for i in range(at % 6)]
        assert memo.many(keys) == [k * 2 for k in keys]
        assert len(memo.young) + len(memo.old) <= 2 * (3 + 6)
    assert len(asked) > 9


def test_ids_are_handed_on_in_parts_and_encoders_serve_many_tasks(spark, monkeypatch):
    """Rows stay in order although a batch of texts comes back as several, whatever the task."""
    monkeypatch.setattr(bpe, "OUT_BYTES", 100)
    texts = [None, "", "word " * 60, "one", "two, three!", "\u00e9t\u00e9 " * 40, ""] * 20
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tokenizer = Tokenizer.from_file(queries.BYTE_BPE)
    out = bpe.decode(bpe.encode(docs, queries.BYTE_BPE), queries.BYTE_BPE).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    for r in out:
        assert r.text == texts[r.doc_id] and r.decoded == (r.text or "")
        assert r.ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids


def test_token_counts(odd, empty):
    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    rows = token_counts.count_tokens(odd, queries.WORD_BPE, limit=20).collect()
    for row in rows:
        n = len(tokenizer.encode(text_of(row), add_special_tokens=False).ids)
        assert (row["n_tokens"], row["n_bytes"]) == (n, len(text_of(row).encode()))
        assert row["over_limit"] == (n > 20)
    assert token_counts.count_tokens(empty, queries.WORD_BPE).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n\r\n" * 100
    pages = [(1, "http://a/1", big), (2, None, big), (3, "x\r\ny: z", big), (-4, "u", None), (5, "u", "short"),
             (6, "u", "short"), (None, "n", big), (7, "", ""), (5, "u", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    warc.write_archives(df.repartition(3), f"{tmp_path}/w")
    rows = warc.assemble(spark, f"{tmp_path}/w").collect()
    got = Counter()
    for r in rows:
        page = r.metadata.payload.decode().strip().removeprefix("page_id:").strip()
        assert r.request.payload == b"" and r.response.declared_digest.endswith(r.response.payload_digest)
        got[page, r.response.record_type, r.response.payload_bytes, r.response.payload_digest] += 1
    want = Counter()
    for page, _, html in pages:
        data = (html or "").encode()
        kind = "revisit" if html == big and page != 3 else "response"
        want["" if page is None else str(page), kind, len(data), hashlib.sha1(data).hexdigest()] += 1
    assert got == want
    refers = spark.createDataFrame([(r.response.refers_to,) for r in rows], "r string").select(warc.page_of(F.col("r")))
    assert {x[0] for x in refers.collect()} == {None, 3}
    warc.write_archives(df.limit(0), f"{tmp_path}/none")
    assert warc.assemble(spark, f"{tmp_path}/none").count() == 0


def test_archives_of_large_pages_stay_small(spark, tmp_path):
    """A thousand small pages and fifty of 2 MB, the large ones together."""
    small = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("x").alias("html"))
    own = F.concat(F.col("id").cast("string"), F.repeat(F.md5(F.col("id").cast("string")), 65_536))
    large = spark.range(1000, 1050).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), own.alias("html"))
    warc.write_archives(small.unionByName(large).coalesce(1), f"{tmp_path}/w", archive_bytes=16 << 20)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/w").select("content").collect()
    lengths = [len(gzip.decompress(f.content)) for f in files]
    assert max(lengths) <= 16 << 20 and len(lengths) <= 60
    done = warc.assemble(spark, f"{tmp_path}/w")
    assert done.filter("response.payload_bytes > 2000000").count() == 50 and done.count() == 1050
    plan = done.select("response.payload_bytes", "metadata.payload")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1


def test_records_without_partner(spark, tmp_path):
    def record(kind, own, **more):
        head = [f"WARC-Type: {kind}", *([f"WARC-Record-ID: {own}"] if own else []), *(f"{k}: {v}" for k, v in more.items())]
        return "\r\n".join(["WARC/1.1", *head, "Content-Length: 2"]) + "\r\n\r\nxy\r\n\r\n"

    link = {"WARC-Concurrent-To": "<a>"}
    text = record("response", "<a>") + record("response", "<a>") + record("request", "<q2>", **link)
    text += record("request", "<q1>", **link) + record("metadata", "<m>") + record("response", None) + record("request", "<q3>")
    (tmp_path / "w.warc").write_bytes(text.encode())
    rows = warc.assemble(spark, str(tmp_path / "w.warc")).collect()
    got = Counter((r.response.record_id, r.request and r.request.record_id, r.metadata) for r in rows)
    assert got == {("<a>", "<q1>", None): 2, (None, None, None): 1}


@pytest.mark.parametrize("sites", [1, 3, 10])
def test_line_dedup(spark, odd, empty, sites):
    rows = [(1000 + i, f"common line \nown {i}\n  \nrare {i % 2}", None, f"w{i % 7}", 0, "") for i in range(40)]
    docs = odd.unionByName(spark.createDataFrame(rows, odd.schema))
    space = " \t\x0b\x0c\r"
    spread = defaultdict(set)
    for row in docs.collect():
        for line in text_of(row).split("\n"):
            spread[line.strip(space)].add(row["source"] or "")
    bad = {k for k, v in spread.items() if k and len(v) >= sites}
    want = Counter()
    for row in docs.collect():
        left = None if row["text"] is None else [x for x in row["text"].split("\n") if x.strip(space) not in bad]
        want[row["doc_id"], None if left is None else "\n".join(left)] += 1
    cleaned = line_dedup.remove_spread_lines(docs, min_sites=sites).collect()
    assert Counter((r["doc_id"], r["text"]) for r in cleaned) == want
    assert line_dedup.remove_spread_lines(empty).count() == 0


def test_language_id(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op8_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    profiles = language_id.learn(odd)
    judged = {r["text"]: r for r in language_id.predict(odd, profiles).collect()}
    assert [judged[t]["lang_pred"] for t in (None, "", " ", "\n\n")] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in judged.values())
    assert language_id.learn(empty) == {} and language_id.predict(empty, {}).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, {}).collect()} == {"und"}


def components(rows):
    """Smallest reachable id per row number, by comparing all pairs of sets."""
    sets = []
    for row in rows:
        w = text_of(row).encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    least = {i: min((rows[k]["doc_id"] for k in g if rows[k]["doc_id"] is not None), default=None)
             for g in groups.values() for i in g}
    return least, sets, len(groups)


def test_near_groups(spark, odd, empty):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):  # a family of copies, edited a little or much, partly in the same places
        words = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3, 5, 8])):
            words[k] = rng.choice(["x", f"own{i}"])
        rows.append((2000 + i, " ".join(words), None, None, -1, "x"))
    docs = odd.unionByName(spark.createDataFrame(rows, odd.schema))
    source = docs.collect()
    least, sets, n = components(source)
    got = near_dedup.near_groups(docs).collect()
    want = Counter((r["doc_id"], least[i], len(sets[i])) for i, r in enumerate(source))
    assert Counter((r.doc_id, r.component_id, r.n_shingles) for r in got) == want
    assert sum(r.kept for r in got) == n
    assert near_dedup.near_groups(empty).count() == 0


def test_connected_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51)], "a long, b long")
    run = near_dedup._Run()
    found = {r.node: r.component for r in near_dedup.connected(links, run).collect()}
    assert found == {**{i: 1 for i in range(2, 41)}, 51: 50}


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</turn>&lt;&amp;<turn esc assistant>\n"), (1, 1, None, None), (1, 2, "as>\n<&si", "a<"),
            (None, 3, "assistant", "é🎉</turn>x"), (None, 2, "assistant", "y</tur"), (None, 2, "assistant", "y</tur"),
            (2, None, "assistant", ""), (-7, 0, "user", queries.CONTROL_TEXT), (-7, 1, "assistant", queries.CONTROL_TEXT)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    done = chat.format_conversations(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("turn_spans")))
    got = {r.conv_id: r for r in done.collect()}
    by_conv = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by_conv[row[0]].append((row[2] or "", row[3] or ""))
    for conv, turns in by_conv.items():
        r = got[conv]
        assert r.identical and [(t.role, t.text) for t in r.turns] == turns
        assert r.loss == "".join(text for role, text in turns if role == "assistant")
    assert got[-7].escaped_turns == 2 and got[2].escaped_turns == 0
    assert chat.format_conversations(df.limit(0)).count() == 0


CLASHING = ["_id", "_hits", "_judged", "_p", "_q_words", "row", "id", "places", "words", "Text2"]


def test_columns_named_like_working_ones(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source").withColumns({c: F.lit(c) for c in CLASHING})
    results = [
        line_dedup.remove_spread_lines(docs, min_sites=3),
        language_id.predict(docs, language_id.learn(docs)),
        packing.token_pieces(docs, queries.WORD_BPE),
        quality.apply_rules(docs),
        near_dedup.near_groups(docs),
        exact_dedup.exact_groups(docs),
        token_counts.count_tokens(docs, queries.WORD_BPE),
    ]
    for result in results:
        assert result.select(*CLASHING).distinct().collect() == [tuple(CLASHING)]


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def test_long_texts_take_time_in_proportion(spark):
    def lines(n):
        text = "\n".join(f"l{i}" for i in range(n))
        rows = [(i, text, f"s{i}") for i in range(12)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        out = line_dedup.remove_spread_lines(docs).agg(F.max(F.length("text")), F.min("n_removed")).first()
        assert tuple(out) == (0, n)

    def turns(n):
        rows = [(1, i, "assistant" if i % 2 else "user", f"</turn>{i}") for i in range(n)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        done = chat.format_conversations(df)
        loss = done.select(chat.loss_text(F.col("formatted"), F.col("turn_spans"))).first()[0]
        assert loss == "".join(f"</turn>{i}" for i in range(1, n, 2))

    for work, n in ((lines, 40_000), (turns, 10_000)):
        work(n // 4)
        assert seconds(lambda: work(n)) < 12 * max(1.0, seconds(lambda: work(n // 4)))


def test_a_template_too_small_for_links_forms_no_pairs(spark, monkeypatch):
    """300 texts share 160 of 200 shingles (0.67, no links); two shorter ones are linked."""
    template = [f"t{i}" for i in range(164)]
    rows = [(i, " ".join([*template, *(f"o{i}x{k}" for k in range(40))])) for i in range(300)]
    rows += [(1000, " ".join(template[:160])), (1001, " ".join(template[:164]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = {}
    keep = near_dedup._verified

    def counted(pairs, sets):
        sizes[len(sizes)] = pairs.count()
        return keep(pairs, sets)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    least, _, n = components(docs.collect())
    got = near_dedup.near_groups(docs).collect()
    assert sum(r.kept for r in got) == n
    assert {r.doc_id: r.component_id for r in got} == {r.doc_id: least[i] for i, r in enumerate(docs.collect())}
    assert max(sizes.values()) < 2000
