"""Bucketed store: the insert-ignore anti-join does not re-shuffle the store."""

from opinio.operators.ingest import insert_ignore
from opinio.sources.store import read_store, save_bucketed


def test_bucketed_store_avoids_store_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = spark.range(0, 5000).selectExpr("concat('u', CAST(id AS STRING)) AS url", "id AS pos")
        save_bucketed(stored, "store_headers_test", ["url"], 8)
        batch = spark.range(4990, 5010).selectExpr("concat('u', CAST(id AS STRING)) AS url", "id AS pos")
        new = insert_ignore(batch, read_store(spark, "store_headers_test"), ["url"], order_col="pos")
        assert sorted(r.url for r in new.collect()) == [f"u{i}" for i in range(5000, 5010)]
        plan = new._jdf.queryExecution().executedPlan().toString()
        scan_lines = [ln for ln in plan.split("\n") if "store_headers_test" in ln]
        assert scan_lines and all("Bucketed: true" in ln for ln in scan_lines)
        # only the batch side is exchanged for the join: the store scan feeds the join directly
        join_part = plan[plan.index("SortMergeJoin"):] if "SortMergeJoin" in plan else plan
        store_branch = join_part[join_part.rindex("+-"):]
        assert "Exchange" not in store_branch
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS store_headers_test")


def test_model_filter_reaches_parquet_scan(spark, tmp_path):
    from opinio.plans import dashboards as D
    from opinio.sources.news_model import NewsModel
    path = str(tmp_path / "results")
    spark.createDataFrame([(1, 10, 1, 0.5), (2, 10, 2, -0.5)],
                          "id long, comment_id long, sub_id int, sentiment_value double").write.parquet(path)

    class Stored(NewsModel):
        @property
        def analyzer1_result(self):
            return spark.read.parquet(path)
    r = D._model_results(Stored(spark, "/unused"), D.DashboardParams(nlp_model="Multilanguage Bert"))
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(sub_id), In(sub_id, [2])]" in plan or "EqualTo(sub_id,2)" in plan
    assert [row.sub_id for row in r.collect()] == [2]
