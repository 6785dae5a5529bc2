import zlib

import brute
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillframe.llm import katz
from quillframe.llm import queries as llm
from quillframe.llm.tokens import encoder

#: Columns that each query must have; more may follow.
CONTRACT = {
    1: "slot bigint, doc_id bigint, start bigint, length bigint, whole boolean",
    2: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    3: "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    4: "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    5: "doc_id bigint, held_out boolean, score double, predicted int",
    6: "file int, ordinal bigint, start bigint, n_tokens bigint, closed boolean",
    7: "query_id bigint, rank int, vec_id bigint, score bigint",
    8: "doc_id bigint, n_items bigint, item_ids string, contaminated boolean",
    9: "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    10: "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    11: "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double",
    12: "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    13: "lang string, source string, part string, item string, value bigint, rank int",
}
NAMES = {int(n[2:].split("_")[0]): n for n in llm.QUERIES}


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_sql(spark, sf, name):
    assert oracle.compare(spark, sf, llm.QUERIES[name], llm.ORACLES[name]) is None


def test_names():
    assert sorted(NAMES) == list(range(1, 14)) and len(NAMES) == len(llm.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("number", sorted(CONTRACT))
def test_columns(spark, sf, number):
    kinds = dict(llm.QUERIES[NAMES[number]](spark, sf).dtypes)
    for column in CONTRACT[number].split(", "):
        name, kind = column.split(" ")
        assert kinds[name] == kind


def test_op1_slots_are_dense(spark, sf):
    got = llm.QUERIES[NAMES[1]](spark, sf).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got))) and all(r.whole for r in got)


def test_op2_by_its_law(spark, sf, texts):
    got = llm.QUERIES[NAMES[2]](spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(texts) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    assert set(got["shard"]) <= set(range(8))
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    sums = got.groupby("shard")["size"].sum()
    assert np.ptp(sums) <= max(got["size"].max(), 0.05 * sums.mean())


def test_op3_base_and_counts(spark, sf, texts):
    rows = sorted(texts.items())
    learns = lambda i: brute.crc_mod(i, 10) != 0
    want, _ = brute.katz(rows, learns, katz.good_turing)
    got = {r.doc_id: r for r in llm.QUERIES[NAMES[3]](spark, sf).collect()}
    for i, n, known, train, base, score in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learns(i), n, known, train)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and abs(r.score - score) < 1e-6 * max(1, abs(score))


def test_op5_rows(spark, sf, texts):
    got = llm.QUERIES[NAMES[5]](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (brute.crc_mod(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op6_counts(spark, sf, texts):
    got = llm.QUERIES[NAMES[6]](spark, sf).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(encoder().plain(t)) for t in texts.values())
    assert all(r.closed for r in got)


def test_op9_pieces(spark, sf, texts):
    got = llm.QUERIES[NAMES[9]](spark, sf).orderBy("doc_id", "start").toPandas()
    assert sorted(set(got.doc_id)) == sorted(texts)
    for i, own in got.groupby("doc_id"):
        ids = np.append(encoder().encode(texts[i]), 1).astype("<u4")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 2048


def test_per_document_queries_have_each_document(spark, sf, texts):
    for number in (2, 3, 4, 5, 8, 10, 11):
        got = llm.QUERIES[NAMES[number]](spark, sf)
        assert got.count() == len(texts) and got.select(F.countDistinct("doc_id")).first()[0] == len(texts)
