"""Request streams: bursts, latest-wins lists with pause and resume, newest point requests."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Paused tiles that keep their work; running at once.
MOST_PAUSED, MOST_RUNNING = 8, 6


def debounce(events: DataFrame, key: str = "path", ts: str = "ts", gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One row for each burst of a key: its last event's time and how many there were."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("burst"), key)
        .agg(F.max(ts).alias("fires"), F.count("*").alias("events"))
        .select(key, "fires", "events")
    )


class Scheduler:
    """Wanted tiles of one viewer: a new list replaces the old one; unwanted running tiles are paused, wanted paused ones go on, and a new generation cancels all."""

    def __init__(self, state: dict | None = None):
        state = state or {}
        self.generation: int | None = state.get("generation")
        self.running: list[str] = list(state.get("running", []))
        self.paused: list[str] = list(state.get("paused", []))
        self.queue: list[str] = list(state.get("queue", []))

    def to_dict(self) -> dict:
        return {"generation": self.generation, "running": self.running, "paused": self.paused, "queue": self.queue}

    def want(self, generation: int, tiles: Iterable[str]) -> list[tuple[str, str]]:
        """(act, tile) in order: cancel, pause, resume, start."""
        acts: list[tuple[str, str]] = []
        wanted = list(dict.fromkeys(tiles))
        if generation != self.generation:
            acts += [("cancel", t) for t in self.running + self.paused]
            self.running, self.paused, self.generation = [], [], generation
        for t in [t for t in self.running if t not in wanted]:
            self.running.remove(t)
            self.paused.append(t)
            acts.append(("pause", t))
        while len(self.paused) > MOST_PAUSED:  # the oldest go, also if they are wanted again: then they start anew
            acts.append(("cancel", self.paused.pop(0)))
        self.queue = [t for t in wanted if t not in self.running]
        return acts + self.pump()

    def pump(self) -> list[tuple[str, str]]:
        acts = []
        while self.queue and len(self.running) < MOST_RUNNING:
            t = self.queue.pop(0)
            if t in self.paused:
                self.paused.remove(t)
                acts.append(("resume", t))
            else:
                acts.append(("start", t))
            self.running.append(t)
        return acts

    def done(self, tile: str) -> list[tuple[str, str]]:
        if tile in self.running:
            self.running.remove(tile)
        return self.pump()


ACTS = "viewer long, seq long, act string, tile string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    scheduler = Scheduler(json.loads(state.get[0]) if state.exists else None)
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for seq, generation, tiles in zip(rows["seq"], rows["generation"], rows["tiles"], strict=True):
        acts = scheduler.done(tiles) if generation < 0 else scheduler.want(int(generation), tiles.split(",") if tiles else [])
        out += [(key[0], int(seq), act, tile) for act, tile in acts]
    state.update((json.dumps(scheduler.to_dict()),))
    yield pd.DataFrame(out, columns=["viewer", "seq", "act", "tile"])


def schedule(requests: DataFrame) -> DataFrame:
    """Acts of each viewer's scheduler over a stream (viewer, seq, generation, tiles joined by commas); generation -1: that tile is done."""
    return requests.groupBy("viewer").applyInPandasWithState(_advance, ACTS, "state string", "append", GroupStateTimeout.NoTimeout)


def newest(requests: DataFrame, key: str, order: str) -> DataFrame:
    """The newest request of each key so far; run with output mode complete or update."""
    columns = [c for c in requests.columns if c != key]
    return requests.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it wrote under ``path``."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{'now' if mode == 'complete' else f'batch={number}'}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out/now" if mode == "complete" else f"{path}/out").drop("batch")
