"""NULLs, empty and long texts, ties, repeated rows, clashing names and empty tables, through every query and stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import STAGES, run
from weftline.llm import licenses
from weftline.llm.queries import QUERIES

PER_DOCUMENT = ["op1_toxicity", "op2_quality", "op3_lm", "op7_language", "op8_simhash", "op9_token_counts", "op10_bpe", "op12_rules", "op13_alignment"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_for_each_row(spark, odd, name):
    want = sorted(str(r[0]) for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id").collect())
    got = QUERIES[name](spark, odd)
    assert sorted(str(r["doc_id"]) for r in got.select("doc_id").collect()) == want


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_quality", "op7_language"])
def test_scores_are_shares(spark, odd, name):
    assert QUERIES[name](spark, odd).where("score IS NULL OR score < 0 OR score > 1 OR isnan(score)").count() == 0


def test_no_letter_has_no_language(spark, odd):
    got = {r["doc_id"]: r["lang_pred"] for r in QUERIES["op7_language"](spark, odd).where("doc_id IS NOT NULL").collect()}
    assert [got[i] for i in (60, 61, 62, 63)] == ["und"] * 4 and got[64] != "und"


def test_items_found_once(spark, odd):
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in QUERIES["op4_decontaminate"](spark, odd).collect()}
    assert {(7, 1, 0), (7, 5, 0)} <= got and not {d for d, _, _ in got} & {60, 61, 62, 63}


def test_licenses_in_odd_documents(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    notices = {r["doc_id"]: r["text"] for r in docs.where("doc_id IN (0, 5)").collect()}
    templates = spark.createDataFrame([("a", notices[0]), ("b", notices[5])], "license string, notice string")
    got = {(r["doc_id"], r["license"], r["containment"]) for r in licenses.scan(docs, templates).collect()}
    assert got == {(0, "a", 1.0), (70, "a", 1.0), (71, "a", 1.0), (5, "b", 1.0), (None, "b", 1.0)}
    assert QUERIES["op5_licenses"](spark, odd).count() == 0


def test_stages_on_odd_and_empty_documents(spark, odd, empty):
    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            rows = [Counter(str(r) for r in x.select(F.xxhash64(*docs.columns), "doc_id").collect()) for x in (out, docs)]
            assert rows[0] <= rows[1], name
        assert STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_pipeline(spark, odd, empty):
    assert run(spark, empty).count() == 0
    out = run(spark, odd)
    kept = {r[0] for r in out.select("doc_id").collect()}
    assert kept and not kept & {60, 61, 62, 63} and out.where(~F.col("round_trip")).count() == 0
