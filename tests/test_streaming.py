from verisieve.streaming import traces


def test_stream_counts_each_episode_once(spark, tmp_path):
    rows = [("r", "s", f"e{i % 5}", f"2025-01-0{1 + i % 2} 00:00:00", i % 3 == 0) for i in range(10)]
    d = spark.createDataFrame(rows, "run_id string, suite string, id string, t string, passed boolean").selectExpr("run_id", "suite", "id", "cast(t as timestamp) as t", "passed")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    s = traces.first_seen(traces.stream(spark, str(tmp_path / "in"), d.schema, 1), ["run_id", "suite", "id"], "t", "30 days")
    traces.run_to_end(s, str(tmp_path / "out"), str(tmp_path / "state"))
    once = spark.read.parquet(str(tmp_path / "out"))
    assert once.count() == 5
    traces.run_to_end(s, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert sum(r.n for r in traces.pass_rates(once, "t", "passed", ["suite"]).collect()) == 5
