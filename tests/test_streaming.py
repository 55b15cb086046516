from pyspark.sql import functions as F

from callmetrics.plans.views import read
from callmetrics.streaming import incremental as inc


def test_scoring_goes_on_where_it_stopped(spark, sf, tmp_path):
    src, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = read(spark, sf, "predictions")
    rows.where("record_id % 2 = 0").write.json(src)
    inc.run_scoring(spark, src, sink, state).awaitTermination()
    half = spark.read.parquet(sink).count()
    assert half == rows.where("record_id % 2 = 0").select("record_id").distinct().count()
    rows.where("record_id % 2 = 1").write.mode("append").json(src)
    inc.run_scoring(spark, src, sink, state).awaitTermination()
    out = spark.read.parquet(sink)
    assert out.where("harmful_injection IS NULL OR baseline_name IS NULL").count() == 0 and out.count() > half


def test_pending(spark):
    plan = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "k int, m string")
    assert {tuple(r) for r in inc.pending(plan, plan.limit(1), ["k", "m"]).collect()} == {(2, "a"), (2, "b")}


def test_windows(spark, sf):
    events = read(spark, sf, "events")
    got = inc.windowed(events).agg(F.sum("events")).first()[0]
    assert got == events.count()
