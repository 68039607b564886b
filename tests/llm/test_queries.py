"""The registered queries against their SQL, and learnt models on held-out rows."""

import pytest

from clickfeat.llm.oracles import ORACLE
from clickfeat.llm.queries import QUERIES, op7_toxicity, op8_language
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    ok, _, _, msg = compare(spark, duck(SF), name, QUERIES[name], ORACLE[name], SF)
    assert ok, msg


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def held_out(spark, query, sf, other):
    other = spark.read.parquet(f"{sf}/{other}.parquet")
    return query(spark, sf).where("held_out").join(other, "doc_id").collect()


def test_language_on_held_out_documents(spark):
    rows = held_out(spark, op8_language, "/root/testdata/sf0.01", "documents")
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_toxicity_on_held_out_labels(spark):
    rows = held_out(spark, op7_toxicity, "/root/testdata/sf0.1", "labels")
    hit = sum(r.toxic and r.predicted for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.75 and hit / sum(r.predicted for r in rows) > 0.9
