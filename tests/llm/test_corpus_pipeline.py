"""The pipeline against a chain of slow stages, stage by stage, and its rules of the house."""

import os
import subprocess
import sys
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
import slow
from tokenizers import Tokenizer

from millrace.llm.oracles import ORACLES


def by_sql(rows, name):
    """The SQL of a corpus query over these documents."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r) for r in rows])
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    return {r["doc_id"]: r for r in (dict(zip(names, row, strict=True)) for row in result.fetchall())}


def slow_stages(rows):
    """What each stage but the last keeps, as sets of rows."""
    judged = by_sql(rows, "op2_quality_rules")
    rows = [r for r in rows if judged[r[0]]["kept"]]
    yield rows
    profiles = slow.learned((r[1], r[2]) for r in rows)
    found = [slow.language(r[1], profiles) for r in rows]
    rows = [r for r, (lang, score) in zip(rows, found, strict=True) if lang != "und" and score >= corpus_pipeline.MIN_SCORE]
    yield rows
    cleaned = by_sql(rows, "op7_line_dedup")
    rows = [(r[0], cleaned[r[0]]["text"], *r[2:4], len(cleaned[r[0]]["text"])) for r in rows]
    yield rows
    near = by_sql(rows, "op9_minhash_dedup")
    yield [r for r in rows if near[r[0]]["kept"]]


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_against_slow_stages(spark, size):
    sf_dir = f"/root/testdata/sf{size}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], slow_stages(rows), strict=True):
        docs = corpus_pipeline.write_and_read(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        assert Counter(map(tuple, docs.collect())) == Counter(want), name
    tokenizer = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    placed = corpus_pipeline.run(spark, sf_dir).collect()
    pieces = Counter(p for r in want for p in slow.pieces(tokenizer, r[0], r[1]))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == pieces
    slow.check_places(placed)


def test_pipeline_keeps_labelled_good_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").join(docs, "doc_id").select(docs["*"])
    long = good.filter("n_chars > 600")
    kept = corpus_pipeline.quality_rules(spark, long, sf_dir)
    assert kept.count() >= 0.99 * long.count()


def test_odd_documents(spark):
    """Nulls in any column, empty and repeated rows, an empty table, a further column."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, "s", 0)]
    rows += [(3 + i % 3, "the cat of the house is in a garden and on it was for that with " * 1 + f"word{i % 2} " * 1
              + " ".join(f"the w{k} of x{k}" for k in range(40)), "en", None, 9) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        state = table.select("*", *[table.doc_id.alias(c) for c in ("row", "kept")])
        for name, stage in corpus_pipeline.STAGES[:-1]:
            state = corpus_pipeline.write_and_read(stage(spark, state, ""), name)
            assert state.columns == corpus_pipeline.COLUMNS
        placed = corpus_pipeline.STAGES[-1][1](spark, state, "").collect()
        assert {r.doc_id for r in placed} == ({3} if table is docs else set())


def test_rest_does_not_import_the_operators():
    code = "import sys, millrace.plans.table_queries; print([m for m in sys.modules if m.startswith('millrace.llm')])"
    root = corpus_pipeline.__file__.rpartition("/")[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout.strip() == "[]"


@pytest.mark.parametrize("missing", ["public_tokenizers", "tokenizers", "corpus_pipeline", "millrace.llm"])
def test_other_queries_stay_without_a_package(missing, tmp_path):
    root = os.path.dirname(corpus_pipeline.__file__)
    code = f"import sys; sys.modules[{missing!r}] = None; sys.path.insert(0, {root!r}); import __spark_entry__ as e\n"
    code += "print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith('op')])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.strip() == "70 70 []", done.stderr[-500:]
