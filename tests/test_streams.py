"""Streams against the batch results: fetched days in the store, and the life of opportunities after every run."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import lifecycle
from tidemark.sources import sinks
from tidemark.streaming import detections, sync


def rows_of(df):
    return sorted((r.date.isoformat(), r.page, r.query, r.clicks) for r in df.collect())


def fetch(spark, day, at, *rows, name="sc-domain:s.com"):
    made = [(name, dt.date(2026, 1, day), dt.datetime(2026, 2, at), page, query, clicks, 10, 2.0) for page, query, clicks in rows]
    return spark.createDataFrame(made, sync.ROWS)


def test_days_that_come_twice_and_late(spark, tmp_path):
    one = fetch(spark, 1, 5, ("https://s.com/a", None, 1), ("https://s.com/a/", "", 2), ("https://s.com/a", "q", 1))
    two = fetch(spark, 2, 6, ("https://s.com/b", "", 5))
    old, new = fetch(spark, 2, 3, ("https://s.com/b", "", 77)), fetch(spark, 1, 9, ("https://s.com/a", "", 8))
    gone = fetch(spark, 2, 10, (None, None, None))
    want = [[*rows] for rows in ([("2026-01-01", "https://s.com/a", "", 8), ("2026-01-02", "https://s.com/b", "", 5)], [("2026-01-01", "https://s.com/a", "", 8)])]
    for k, order in enumerate(([one, two, old, new], [two, new, one, old, two, new], [new.unionByName(one), old.unionByName(two), one])):
        write = sync.day_writer(str(tmp_path / f"s{k}"))
        for epoch, rows in enumerate(order):
            write(rows, epoch)
        assert rows_of(sync.stored_facts(spark, str(tmp_path / f"s{k}"))) == want[0]
        write(gone, 9)
        write(gone, 9)
        assert rows_of(sync.stored_facts(spark, str(tmp_path / f"s{k}"))) == want[1]
        assert sync.stored_days(spark, str(tmp_path / f"s{k}")).count() == 2
        write(one.limit(0), 10)


def test_a_batch_that_broke_off_is_made_whole(spark, tmp_path, monkeypatch):
    """Facts are written, the times of fetching are not: the batch runs again and leaves the same."""
    write, path = sync.day_writer(str(tmp_path)), str(tmp_path)
    write(fetch(spark, 1, 5, ("https://s.com/a", "", 1)), 0)
    swap = sinks.swap_snapshot
    monkeypatch.setattr(sinks, "swap_snapshot", lambda *a: 1 / 0)
    late = fetch(spark, 1, 6, ("https://s.com/a", "", 2))
    try:
        write(late, 1)
    except ZeroDivisionError:
        pass
    monkeypatch.setattr(sinks, "swap_snapshot", swap)
    write(late, 1)
    assert rows_of(sync.stored_facts(spark, path)) == [("2026-01-01", "https://s.com/a", "", 2)]


SNAPSHOT = "id string, page_id long, type string, status string, score double, clicks long, impressions long, ctr double, position double, date_start date, date_end date, dismissed_by string, dismissed_at timestamp, dismiss_reason string, run_id string, last_detected_at timestamp"


def test_detections_equal_the_batch_after_every_run(spark, tmp_path):
    """Four runs and a user's dismissals, one stream run for each with the same checkpoint, against snapshots folded in batch."""
    seen = {1: [1, 2, 3, 4], 2: [1, 3, 5], 3: [2, 3, 4, 5], 4: [1, 2, 4]}
    user = {1: [3], 2: [1], 3: [5]}
    time = lambda d, hour=0: dt.datetime(2026, 1, d, hour)
    snapshot = spark.createDataFrame([], SNAPSHOT)
    for d, pages in seen.items():
        run = f"run-{d}"
        found = spark.createDataFrame([(p, "LOW_CTR", float(10 * d + p), 1, 2, 0.5, 3.0, time(1).date(), time(2).date()) for p in pages], "page_id long, type string, score double, clicks long, impressions long, ctr double, position double, date_start date, date_end date")
        snapshot = lifecycle.clear_stale(lifecycle.upsert_detected(snapshot, found, run, str(time(d)), 1), run, str(time(d))).drop("action")
        hit = snapshot.where(F.col("page_id").isin(user.get(d, [])) & F.col("status").isin(*lifecycle.REFRESHABLE))
        snapshot = lifecycle.dismissed(snapshot, hit.select("id", F.lit("u").alias("user_id"), F.lit("NO").alias("reason")), str(time(d, 12)))
        snapshot = spark.createDataFrame(snapshot.select([x.split()[0] for x in SNAPSHOT.split(", ")]).collect(), SNAPSHOT)

        events = [(time(d), p, "LOW_CTR", "detected", run, float(10 * d + p), None, None) for p in pages] + [(time(d, 12), p, "LOW_CTR", "dismissed", None, None, "u", "NO") for p in user.get(d, [])]
        spark.createDataFrame(events + [(None, 1, "x", "detected", "r", 1.0, None, None)], detections.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(detections.EVENTS).parquet(str(tmp_path / "in"))
        detections.run_changes(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), snooze_days=1)

        changes = spark.read.schema(detections.CHANGES).parquet(str(tmp_path / "out"))
        now = detections.current(detections.closed(changes, time(d, 13)))
        newest = snapshot.groupBy("page_id", "type").agg(F.max_by(F.struct("status", "score"), "last_detected_at").alias("x"), F.count("*").alias("n")).select("page_id", "x.status", "x.score", "n")
        assert sorted(map(tuple, now.select("page_id", "status", "score", "n_created").collect())) == sorted(map(tuple, newest.collect()))
    assert changes.groupBy("page_id", "type", "at", "action").count().where("count > 1").isEmpty()


def test_a_life_in_order():
    life = detections.Life(1, "x", None, detections.DAY, 28 * detections.DAY)
    day = detections.DAY
    for at, kind, who in ((0, "detected", None), (day, "detected", None), (day, "reviewed", None), (5 * day, "dismissed", "u"), (6 * day, "detected", None), (34 * day, "detected", None), (36 * day, "detected", None)):
        life.event(at, kind, f"run-{at // day}", 1.0, who, None)
    assert [(c[9], c[6].value // 10**6 // day) for c in life.changes] == [("created", 0), ("updated", 1), ("reviewed", 1), ("dismissed", 5), ("created", 34), ("cleared", 35), ("created", 36)]


def test_events_of_a_frame():
    import pandas as pd

    frame = pd.DataFrame({"at": pd.to_datetime(["2026-01-02 00:00:00.5", "2026-01-01 00:00:00.0"]), "kind": ["detected", "dismissed"], "run_id": ["r", None], "score": [1.5, float("nan")], "user_id": [None, "u"], "reason": [None, None]})
    assert [r[1:] for r in detections.rows_of(frame)] == [("detected", "r", 1.5, None, None), ("dismissed", None, None, "u", None)]
    assert [r[0] for r in detections.rows_of(frame)] == [1767312000500, 1767225600000]


def test_stream_inputs_are_not_written_by_one_task(spark, small, monkeypatch):
    from pyspark.sql import DataFrame

    import __spark_entry__

    monkeypatch.setattr(DataFrame, "coalesce", None)
    assert __spark_entry__.queries()["detection_stream"](spark, small).count() > 0


def test_lives_of_neighbours_are_one_row_of_state(spark, tmp_path):
    """Some hundred pages in three runs: the changes of each page's own life, whatever its neighbours have, and few rows of state."""
    import random

    rng, day, pages = random.Random(5), detections.DAY, range(-40, 700)
    time = lambda at: dt.datetime(2026, 1, 1) + dt.timedelta(milliseconds=at)
    told = []
    for p in pages:
        for d in (d for d in range(9) if rng.random() < 0.4):
            kind = rng.choices(("detected", "reviewed", "dismissed"), (6, 1, 2))[0]
            told.append((d * day + (0 if kind == "detected" else day // 2), p, kind, f"run-{d}" if kind == "detected" else None, float(p + d) if kind == "detected" else None, "u" if kind == "dismissed" else None))
    for run in range(3):
        rows = [(time(at), p, "x", kind, run_id, score, who, None) for at, p, kind, run_id, score, who in told if at // day // 3 == run]
        spark.createDataFrame(rows, detections.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        detections.run_changes(spark.readStream.schema(detections.EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint"), snooze_days=2)
    want = []
    for p in pages:
        life = detections.Life(p, "x", None, day, 2 * day)
        for at, _, kind, run_id, score, who in sorted((r for r in told if r[1] == p), key=lambda r: r[0]):
            life.event(at, kind, run_id, score, who, None)
        life.until(max(r[0] for r in told))
        want += [(c[0], c[2], c[3], c[4], c[5], c[6].value // 10**6, c[7], c[8], c[9]) for c in life.changes]
    start = dt.datetime(2026, 1, 1)
    got = spark.read.schema(detections.CHANGES).parquet(str(tmp_path / "out")).collect()
    got = [(r.page_id, r.id, r.status, r.score, r.run_id, (r.at - start) // dt.timedelta(milliseconds=1), r.dismissed_by, r.reason, r.action) for r in got]
    assert len(got) > 1000 and sorted(map(str, got)) == sorted(map(str, want))
    assert spark.read.format("statestore").load(str(tmp_path / "checkpoint")).count() < 10
