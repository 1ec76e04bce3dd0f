"""The registered queries that SQL cannot express, column by column; those with SQL are in test_parity."""

from collections import Counter

import pytest
import slow
from tokenizers import Tokenizer

from millrace.llm import queries


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()


def test_op1(spark, sf_dir, rows):
    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    got = queries.op1_best_fit_packing(spark, sf_dir).collect()
    want = Counter(p for r in rows for p in slow.pieces(tokenizer, r.doc_id, r.text))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = sum(r.length for r in got)
    assert slow.check_places(got) <= 1.02 * total / 2048 + 1


def test_op4(spark, sf_dir, rows):
    tokenizer = Tokenizer.from_file(queries.BYTE_BPE)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = {}
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = len(ids), slow.sha(",".join(map(str, ids))), slow.sha(decoded)
    got = queries.op4_bpe(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_op6(spark, sf_dir, rows):
    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    got = queries.op6_token_counts(spark, sf_dir).collect()
    want = {}
    for r in rows:
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id] = len((r.text or "").encode()), n, n > 2048
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == want


def test_op8(spark, sf_dir, rows):
    profiles = slow.learned((r.text, r.lang) for r in rows if not slow.held_out(r.doc_id))
    want = {r.doc_id: (slow.held_out(r.doc_id), *slow.language(r.text, profiles)) for r in rows}
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op8_language_id(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for doc_id, (held, lang, score) in want.items():
        assert got[doc_id][:2] == (held, lang) and got[doc_id][2] == pytest.approx(score, abs=1e-12)


def test_columns_of_the_contract(spark, sf_dir):
    kinds = {
        "op1_best_fit_packing": {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
                                 "sequence_id": "bigint", "offset": "bigint"},
        "op11_prefix_trie": dict.fromkeys(
            ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"], "bigint"),
        "op12_structure_repair": dict.fromkeys(
            ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], "bigint") | {"audit": "string"},
        "op13_suffix_array_dedup": {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    }
    for name, columns in kinds.items():
        found = dict(queries.QUERIES[name](spark, sf_dir).dtypes)
        assert {c: found[c] for c in columns} == columns
