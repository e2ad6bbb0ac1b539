from __future__ import annotations

from datetime import datetime, timedelta

from scenewright.streaming import ingest

START = datetime(2024, 1, 1)


def drive(spark, folder, rows, schema, plan, mode, name, batches=1):
    """Rows in files that a stream reads one after the other."""
    n = -(-len(rows) // batches)
    for i in range(batches):
        part = rows[i * n : (i + 1) * n]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = plan(stream).writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_frame_rates_close_with_the_watermark(spark, tmp_path):
    rows = [(START + timedelta(minutes=m), "a", m) for m in (0, 10, 50, 70, 240)]
    got = drive(spark, tmp_path / "in", rows, "ts timestamp, run string, frame_id long", ingest.frame_rates, "append", "rates", batches=5)
    assert sorted((r["window_start"].hour, r["n_frames"]) for r in got) == [(0, 3), (1, 1)]


def test_recordings_split_at_gaps(spark, tmp_path):
    rows = [(START + timedelta(minutes=m), "a", m) for m in (0, 10, 50, 55, 400)]
    got = drive(spark, tmp_path / "in", rows, "ts timestamp, run string, frame_id long", ingest.recordings, "append", "recs", batches=5)
    assert sorted(r["n_frames"] for r in got) == [2, 2]


def test_first_sight(spark, tmp_path):
    rows = [(START, "a", 1), (START, "a", 1), (START, "a", 2)]
    assert len(drive(spark, tmp_path / "in", rows, "ts timestamp, run string, frame_id long", ingest.first_sight, "append", "sight")) == 2


def test_states_follow_allowed_moves_only(spark, tmp_path):
    rows = [
        ("x", 1, "SAMPLE_VERIFIED", "pass"),
        ("x", 2, "GEOMETRY_READY", "pass"),
        ("x", 3, "INGESTED", "reject"),
        ("x", 4, "QUARANTINED", None),
        ("y", 1, "REJECTED", None),
        ("y", 2, "REGISTERED", "pass"),
    ]
    got = drive(spark, tmp_path / "in", rows, "artifact_id string, seq long, to_state string, gate_status string", ingest.artifact_states, "update", "states")
    assert {(r["artifact_id"], r["state"], r["refused"]) for r in got} == {("x", "QUARANTINED", 2), ("y", "REJECTED", 1)}
