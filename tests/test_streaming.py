from lodestone.streaming import events as S


def test_replay_waits_for_the_stored_status(spark, tmp_path):
    schema = "run_id string, sequence int, type string"
    spark.createDataFrame([("a", 1, "tool.called"), ("a", 2, "run.completed"), ("b", 1, "run.failed")], schema).write.parquet(str(tmp_path / "in"))
    runs = spark.createDataFrame([("a", "completed"), ("b", "running")], "run_id string, status string")
    stream = lambda: S.replay_stream(S.event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), runs).select("run_id", "sequence", "type")
    S.drain(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert {(r.run_id, r.sequence) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 1), ("a", 2)}
    spark.createDataFrame([("a", 3, "tool.called")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    S.drain(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_admission_keeps_state_between_batches(spark, tmp_path):
    schema = "session_id string, attempt_id long, at double"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for part in ([("s", 1, 0.0), ("s", 2, 1.0)], [("s", 3, 2.0), ("s", 4, 100.0)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        S.drain(S.admission_stream(S.event_stream(spark, source, spark.read.parquet(source).schema), 2, 50), out, checkpoint)
    assert {r.attempt_id: r.admitted for r in spark.read.parquet(out).collect()} == {1: True, 2: True, 3: False, 4: True}


def test_runs_time_out_in_event_time(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    batches = [[("a", "run.started", "2025-01-01 00:00:00"), ("b", "run.started", "2025-01-01 00:00:00"), ("a", "run.completed", "2025-01-01 00:00:50")], [("c", "run.started", "2025-01-01 01:00:00")], [("c", "run.completed", "2025-01-01 01:00:10")]]
    for rows in batches:
        spark.createDataFrame(rows, "run_id string, type string, at string").selectExpr("run_id", "type", "CAST(at AS TIMESTAMP_NTZ) AS at").write.mode("append").parquet(source)
        S.drain(S.run_timeouts(S.event_stream(spark, source, spark.read.parquet(source).schema)), out, checkpoint)
    assert {r.run_id: r.state for r in spark.read.parquet(out).collect()} == {"a": "slow", "b": "expired", "c": "ended"}
