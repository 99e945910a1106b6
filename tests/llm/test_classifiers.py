from tessellar.llm import langid, quality

SF = "/root/testdata/sf0.1"


def test_quality_on_held_out_labels(spark):
    """How the classifier does on labels that it has not learned from, also at the pipeline's threshold."""
    rows = quality.op6_quality(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = ([r["predicted"] for r in rows if r["quality"] == y] for y in (1, 0))
    assert sum(good) > 0.95 * len(good) and sum(bad) < 0.1 * len(bad)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    rows = langid.op7_langid(spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.98 * len(rows)
