import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from vicinal.llm import queries, sql
from vicinal.llm.common import read

SF = "/root/testdata/sf0.001"


def plain(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(x.item() if hasattr(x, "item") else x for x in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = plain(queries.QUERIES[name](spark, SF).toPandas()), plain(c.sql(sql.ORACLES[name]).df())
    assert a[0] == b[0] and len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1]):
        assert all(abs(u - v) < 1e-8 if isinstance(u, float) else u == v for u, v in zip(x, y))


def test_queries_without_sql(spark):
    docs = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    got = queries.QUERIES["op6_suffix_dedup"](spark, SF)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == brute.repeats(docs.items())
    for r in queries.QUERIES["op9_secret_scan"](spark, SF).collect():
        base = brute.base_spans(docs[r.doc_id])
        assert r.base_sha256 == brute.sha(",".join(base)) and set(base) <= set(r.spans.split(","))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
    language = queries.QUERIES["op1_language_id"](spark, SF).join(read(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    assert language.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_stages_against_plain_python(spark):
    docs = read(spark, SF, "documents").withColumn("carried", F.lit(1)).withColumn("probability", F.lit("x"))
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        rows = [(d, r.text) for d, r in before.items()]
        docs = corpus_pipeline.table(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "mixing":
            assert docs.columns == columns and all(r.n_chars == len(r.text) for r in after.values())
        if name == "language":
            assert len(after) >= 0.95 * len(before)
        if name == "line_dedup":
            want = {d: w[3] for d, w in brute.line_dedup(rows).items() if not w[1] or brute.WORD.search(w[3])}
            assert {d: r.text for d, r in after.items()} == want
        if name == "near_dups":
            assert set(after) == {d for d, w in brute.near_dups(rows, 5).items() if w[2]}
        if name == "clean_benchmark":
            found = brute.contamination(rows, bench)
            assert set(after) == {d for d, w in found.items() if not w[4]}
            assert all(after[d].text == before[d].text for d in after if not found[d][1])
        if name == "mixing":
            assert 0.3 * len(before) < len(after) < len(before)


def test_stages_on_nothing(spark):
    docs = read(spark, SF, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.table(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_stages_on_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "some words in a text", "en", None, 1), (5, "word " * 30000, "de", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.table(stage(spark, docs, SF), name)
    assert docs.where("doc_id = 5").count() <= 1
