"""Streams over files, and the scheduler as a fold."""

import json
import random
import time

from tessella.streaming import requests as R


def test_scheduler_invariants():
    rng = random.Random(4)
    for _ in range(200):
        s, live = R.Scheduler(), set()
        for _ in range(30):
            if rng.random() < 0.3 and s.running:
                tile = rng.choice(s.running)
                live.discard(tile)
                acts = s.done(tile)
            else:
                wanted = [str(rng.randrange(25)) for _ in range(rng.randrange(14))]
                before = s.generation
                acts = s.want(rng.choice([1, 1, 1, 2]), wanted)
                assert s.generation == before or not any(a == "resume" for a, _ in acts)
                assert set(s.running) <= set(wanted)
            for act, tile in acts:
                if act == "start":
                    assert tile not in live
                    live.add(tile)
                elif act == "cancel":
                    live.discard(tile)
            assert len(s.running) <= R.MOST_RUNNING and len(s.paused) <= R.MOST_PAUSED
            assert live == set(s.running) | set(s.paused) and not set(s.running) & set(s.paused)


def _write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))


def test_schedule_keeps_state_between_batches(spark, tmp_path):
    schema = "viewer long, seq long, generation long, tiles string"
    src = tmp_path / "in"
    src.mkdir()
    _write(src / "a.json", [{"viewer": 1, "seq": 1, "generation": 1, "tiles": "a,b"}, {"viewer": 2, "seq": 1, "generation": 1, "tiles": "x"}])
    stream = lambda: R.schedule(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
    R.run_available(stream(), str(tmp_path / "work"))
    _write(src / "b.json", [{"viewer": 1, "seq": 2, "generation": 1, "tiles": "b,c"}, {"viewer": 1, "seq": 3, "generation": 1, "tiles": "a"}, {"viewer": 1, "seq": 4, "generation": 2, "tiles": ""}])
    got = R.run_available(stream(), str(tmp_path / "work")).where("viewer = 1").orderBy("seq").collect()
    acts = {}
    for r in got:
        acts.setdefault(r["seq"], set()).add((r["act"], r["tile"]))
    assert acts[1] == {("start", "a"), ("start", "b")}
    assert acts[2] == {("pause", "a"), ("start", "c")}
    assert acts[3] == {("pause", "b"), ("pause", "c"), ("resume", "a")}
    assert acts[4] == {("cancel", "a"), ("cancel", "b"), ("cancel", "c")}


def test_debounce_joins_a_burst(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    at = ["00:00:00.000", "00:00:00.200", "00:00:00.900", "00:01:00.000"]
    _write(src / "a.json", [{"path": "f", "ts": f"2024-01-01T{t}"} for t in at])
    stream = spark.readStream.schema("path string, ts timestamp").json(str(src))
    got = R.run_available(R.debounce(stream), str(tmp_path / "work")).orderBy("fires").collect()
    assert [(str(r["fires"])[11:], r["events"]) for r in got][:2] == [("00:00:00.200000", 2), ("00:00:00.900000", 1)]


def test_changes_are_seen_again(spark, tmp_path):
    from tessella.streaming.watch import ChangeReader

    (tmp_path / "a").write_text("1")
    reader = ChangeReader(str(tmp_path))
    rows, offset = reader.read(reader.initialOffset())
    assert len(list(rows)) == 1 and not list(reader.read(offset)[0])
    time.sleep(0.02)
    (tmp_path / "a").write_text("22")
    again, _ = reader.read(offset)
    assert [r[2] for r in again] == [2]


def test_change_stream(spark, tmp_path):
    from tessella.streaming.watch import FileChanges

    spark.dataSource.register(FileChanges)
    src = tmp_path / "in"
    src.mkdir()
    (src / "a").write_text("1")
    stream = spark.readStream.format("file_changes").option("path", str(src)).load()
    query = stream.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(100):
            if spark.table("changes").count():
                break
            time.sleep(0.2)
    finally:
        query.stop()
    assert [r["size"] for r in spark.table("changes").collect()] == [1]
