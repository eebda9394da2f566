"""Plans of the training-data operators: history is joined where it lies, texts are not shuffled for templates."""

from pyspark.sql import functions as F

from sievelark.llm import history as H
from sievelark.llm import markup as M
from sievelark.llm import neardup as N


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_is_not_shuffled(spark, monkeypatch):
    """The stored side of the join is read bucket by bucket: the batch alone is exchanged."""
    monkeypatch.setattr(H, "BUCKETS", 4)
    h = H.fresh(spark)
    rows = "tbl int, batch int, id bigint, url string, title string"
    try:
        h.accept(spark.createDataFrame([(0, 0, i, f"https://a.example/{i}", None) for i in range(100)], rows))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        new = spark.createDataFrame([(1000 + i, i * 14) for i in range(100)], "node bigint, mark bigint").groupBy("mark").agg(F.min("node").alias("own"))
        text = plan(new.join(h.stored(), "mark", "left"))
        assert text.count("Exchange hashpartitioning(mark") == 1 and "Bucketed: true" in text
        again = h.accept(spark.createDataFrame([(0, 1, 1000 + i, f"https://a.example/{2 * i}", None) for i in range(100)], rows))
        assert again.count() == 50 and again.where("root.id = row.id").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
        name = h.name
        h.drop()
    assert not spark.catalog.tableExists(name)


def test_templates_do_not_shuffle_texts(spark):
    df = spark.createDataFrame([("t", "1", "h", "<p>x</p>")], "tbl string, row_key string, host string, text string")
    text = plan(M.with_templates(df))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_anchor_join_has_a_key(spark):
    text = plan(N.shingle_sets(spark.createDataFrame([(1, "a b c d")], "id bigint, text string"), F.col("text")))
    assert "CartesianProduct" not in text and "MapInPandas" in text
