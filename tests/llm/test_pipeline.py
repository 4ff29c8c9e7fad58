"""The pipeline's stages: what each must drop and keep."""

from __future__ import annotations

import pytest

import corpus_pipeline as P
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base, leak, line = prose(1, 120), prose(50, 40), "one line that stands in several documents"
    near = base.split()
    near[3] = "zzz"
    texts = [base, base, " ".join(near), f"{prose(2, 60)} {leak} {prose(3, 60)}", f"{prose(4, 50)}\n{line}", f"{prose(5, 50)}\n{line}", f"{prose(6, 50)}\n{line}", None, ""]
    texts += [prose(100 + i, 50) for i in range(90)] + [" ".join(w + "***" for w in prose(500 + i, 50).split()) for i in range(90)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int("***" not in (t or "")), 0) for i, t in enumerate(texts) if t], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    good = P.quality(spark, docs, folder)
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    assert good.columns == columns and set(range(7)) <= ids and not ids & set(range(99, 189))
    lines = P.line_dedup(spark, docs, folder)
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == columns and len(got) == docs.count()
    assert "\n" not in got[4].text and "\n" not in got[5].text and got[6].text.endswith("documents") and got[4].n_chars == len(got[4].text)
    near = P.near_dedup(spark, docs, folder)
    assert near.columns == columns and sorted(set(range(9)) - {r.doc_id for r in near.select("doc_id").collect()}) == [1, 2]
    clean = P.decontaminate(spark, docs, folder)
    assert clean.columns == columns and {r.doc_id for r in docs.join(clean, "doc_id", "left_anti").collect()} == {3}


def test_run(spark, folder):
    pytest.importorskip("public_tokenizers")
    got = P.run(spark, folder)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert {0, 4, 5, 6} <= ids and not ids & {1, 2, 3} and not ids & set(range(99, 189))
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_null_and_repeated_ids_and_further_columns(spark, folder):
    """Rows without id and rows that repeat one stay apart; columns under names that operators use inside stay as they are."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60")
    more = docs.where("doc_id in (20, 21)").unionByName(docs.where("doc_id = 22").withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.unionByName(more).withColumns({"key": F.lit("k"), "rep": F.lit(1), "n_lines": F.lit(2), "item_id": F.lit(3)})
    lines = P.line_dedup(spark, docs, folder)
    assert lines.columns == docs.columns and lines.count() == 63
    near = P.near_dedup(spark, docs, folder)
    got = [r.doc_id for r in near.collect()]
    assert near.columns == docs.columns and got.count(None) == 1 and not {1, 2} & set(got) and {20, 21, 22} <= set(got)
    clean = P.decontaminate(spark, docs, folder)
    assert clean.columns == docs.columns and clean.count() == 62 and clean.where("doc_id is null").count() == 1
    good = P.quality(spark, docs, folder)
    assert good.columns == docs.columns and {20, 21} <= {r.doc_id for r in good.collect()}


def test_packing_of_no_rows(spark, folder):
    pytest.importorskip("public_tokenizers")
    assert P.packing(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(0), folder).count() == 0


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
