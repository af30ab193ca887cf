from datetime import datetime, timedelta

from quillspark.sources.files import append_events
from quillspark.streaming import events as ev


def put(spark, path, rows):
    t0 = datetime(2026, 1, 1)
    append_events(spark.createDataFrame([(t0 + timedelta(minutes=m), u, h, o, 200) for m, u, h, o in rows], ev.EVENTS).coalesce(1), path)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_mix_and_streaks(spark, tmp_path):
    p = str(tmp_path / "log")
    put(spark, p, [(i, f"u{i}", "h", "failed") for i in range(2)])
    put(spark, p, [(2, "u2", "h", "failed"), (3, "u3", "h", "ok"), (4, "u4", "g", "error"), (5, "u5", None, "failed")])
    run(ev.outcome_mix(ev.event_stream(spark, p)), "mix", "complete")
    assert {(r.host, r.outcome): r.n for r in spark.table("mix").collect()} == {("h", "failed"): 3, ("h", "ok"): 1, ("g", "error"): 1, (None, "failed"): 1}
    run(ev.streaks(ev.event_stream(spark, p), 3), "alarms")
    assert [(r.host, r.length) for r in spark.table("alarms").collect()] == [("h", 3)]


def test_first_seen_and_latest(spark, tmp_path):
    p = str(tmp_path / "log")
    put(spark, p, [(0, "u", "h", "ok"), (1, "u", "h", "ok"), (2, "v", "h", "failed")])
    put(spark, p, [(5, "u", "h", "failed"), (6, "v", "h", "ok")])
    run(ev.first_seen(ev.event_stream(spark, p)), "seen")
    assert sorted((r.url, r.outcome) for r in spark.table("seen").collect()) == [("u", "failed"), ("u", "ok"), ("v", "failed"), ("v", "ok")]
    q = ev.latest_state(ev.event_stream(spark, p), str(tmp_path / "t"), str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.url, r.outcome) for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()) == [("u", "failed"), ("v", "ok")]
