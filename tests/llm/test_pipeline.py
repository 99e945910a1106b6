import corpus_pipeline as P
from tessellar.llm import near

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = P.written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        if name == "near_duplicates":
            groups = near.near_duplicates(docs, near.Settings())
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in groups.where("kept").collect()}
        docs = out
    packed = P.packing_stage(spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_repeated_rows_nulls_and_empty(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "en", "a", 3), (1, text, "en", "a", 3), (1, "else", "en", "a", 4), (2, text, "en", "b", 3), (None, None, None, None, None), (7, None, "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in P.near_stage(spark, docs, SF).collect())
    assert got == [(0, ""), (1, "else"), (1, text), (7, "")]
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).collect()


def test_shared_ids(spark):
    """Rows that share an id go by their own texts; clashing columns and a very long text pass through."""
    text = " ".join(f"word{i}" for i in range(400))
    less = " ".join(f"word{i}" for i in range(1, 400))
    long = "a line of very many words " * 40_000
    rows = [(1, text), (2, text), (2, "a wholly different text with its own words"), (3, less), (4, long), (5, long), (None, text), (None, "quite another text")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, "x", "y", "z", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, version string, _id string, first int")
    got = P.near_stage(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(0, "quite another text"), (1, text), (2, rows[2][1]), (4, long)]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted(want)
    assert P.pii_stage(spark, docs, SF).columns == docs.columns
