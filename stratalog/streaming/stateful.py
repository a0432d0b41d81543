"""Keyed streams with state: windows of events that are due, freshness against marks, near merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stratalog.operators.dedup import BUCKET_CAP, GRAY, MERGE
from stratalog.operators.events import IDLE_SECONDS, READY_EVENTS, WINDOW_EVENTS
from stratalog.operators.fold import Context

WINDOW = "run_id string, pass_no long, cause string, seq long, payload string"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.split(",")])


class Windows(StatefulProcessor):
    """Holds the events of a run until it is due: with `most` of them, or when nothing came for `idle_ms`.

    A pass takes at most `window` events in order of seq. A run that is due for their number hands over full windows
    and a last one if that has `most` events; what is left waits for more or for the timer, which hands over all.
    """

    def __init__(self, most: int, idle_ms: int, window: int):
        self.most, self.idle_ms, self.window = most, idle_ms, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "seq long, payload string")
        self.passes = handle.getValueState("passes", "n long")

    def _hand_over(self, run: str, events: list[tuple], cause: str, least: int) -> pd.DataFrame:
        done = self.passes.get()[0] if self.passes.exists() else 0
        out, at = [], 0
        while len(events) - at >= min(least, self.window):
            done += 1
            some = events[at : at + self.window]
            out += [(run, done, cause, seq, payload) for seq, payload in some]
            at += len(some)
        if at:
            self.passes.update((done,))
        if at < len(events):
            self.events.put(events[at:])
        else:
            self.events.clear()
        return _frame(out, WINDOW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        held += [(int(r.seq), r.payload) for part in rows for r in part.itertuples(index=False)]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        out = self._hand_over(key[0], sorted(held), "count", self.most)
        if self.events.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        yield self._hand_over(key[0], sorted(held), "idle", 1)

    def close(self) -> None:
        pass


def due_windows(stream: DataFrame, most: int = READY_EVENTS, idle_ms: int = int(IDLE_SECONDS * 1000), window: int = WINDOW_EVENTS) -> DataFrame:
    """run_id, pass_no, cause (count, idle), seq and payload of the events of each pass that is due, of a stream of
    events (run_id, seq, payload). Needs the RocksDB state store."""
    rows = stream.select("run_id", F.col("seq").cast("long").alias("seq"), "payload")
    return rows.groupBy("run_id").transformWithStateInPandas(statefulProcessor=Windows(most, idle_ms, window), outputStructType=WINDOW, outputMode="append", timeMode="ProcessingTime")


FRESHNESS = "run_id string, covered_seq long, pending long, oldest timestamp"


class Freshness(StatefulProcessor):
    """Uncovered events of a run by seq, and its mark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "seq long", "at timestamp")
        self.mark = handle.getValueState("mark", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else 0
        fresh = {}
        for part in rows:
            marks = part[part["is_mark"]]
            mark = max([mark, *marks["seq"].tolist()])
            fresh |= {int(r.seq): r.at for r in part[~part["is_mark"]].itertuples(index=False)}
        self.mark.update((int(mark),))
        for seq, at in fresh.items():
            if seq > mark and not self.open.containsKey((seq,)):
                self.open.updateValue((seq,), (at,))
        held = [(k[0], v[0]) for k, v in self.open.iterator()]
        for seq, _ in held:
            if seq <= mark:
                self.open.removeKey((seq,))
        left = sorted((s, a) for s, a in held if s > mark)
        yield _frame([(key[0], int(mark), len(left), left[0][1] if left else None)], FRESHNESS)

    def close(self) -> None:
        pass


def live_lag(events: DataFrame, marks: DataFrame) -> DataFrame:
    """run_id, covered_seq, pending and oldest (the time of the oldest uncovered event, null if there is none) of each
    run that something came for, from a stream of events (run_id, seq, created_at) and one of marks (run_id,
    covered_seq). A mark that comes before its events counts for them as well; marks never go back."""
    rows = events.select("run_id", F.col("seq").cast("long").alias("seq"), F.col("created_at").cast("timestamp").alias("at"), F.lit(False).alias("is_mark"))
    rows = rows.unionByName(marks.select("run_id", F.col("covered_seq").cast("long").alias("seq"), F.lit(None).cast("timestamp").alias("at"), F.lit(True).alias("is_mark")))
    return rows.groupBy("run_id").transformWithStateInPandas(statefulProcessor=Freshness(), outputStructType=FRESHNESS, outputMode="update", timeMode="None")


FOLDED = "project_id string, context_hash string, id long, outcome string, memory_id long, gray boolean, cosine double, version int, replaced_id long, live_id long"


class Fold(StatefulProcessor):
    """The newest `cap` memories of a context with their vectors, and all its live fingerprints."""

    def __init__(self, merge: float, gray: float, cap: int):
        self.merge, self.gray, self.cap = merge, gray, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "id long, hash string, row long, version int, vec array<double>")
        self.live = handle.getMapState("live", "hash string", "id long, row long, version int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["arrival", "id"], kind="stable")
        context = Context(self.cap)
        if self.ring.exists():
            for memory_id, hash_, row, version, vec in self.ring.get():
                context.add({"id": memory_id, "hash": hash_, "row": row, "version": version}, np.asarray(vec, dtype=np.float64))
        for hash_ in set(found["content_hash"]) - set(context.by_hash):
            if self.live.containsKey((hash_,)):
                memory_id, row, version = self.live.getValue((hash_,))
                context.add({"id": memory_id, "hash": hash_, "row": row, "version": version}, None)
        before, out = set(context.by_hash), []
        for r in found.itertuples(index=False):
            vec = np.asarray(r.vec, dtype=np.float64)
            out.append((*key, r.id, *context.fold(r.id, r.content_hash, vec, self.merge, self.gray)))
        for hash_ in before - set(context.by_hash):
            self.live.removeKey((hash_,))
        for hash_, m in context.by_hash.items():
            self.live.updateValue((hash_,), (int(m["id"]), int(m["row"]), int(m["version"])))
        order = [*range(context.next, len(context.ring)), *range(context.next)]  # the oldest first
        self.ring.put([(int(m["id"]), m["hash"], int(m["row"]), int(m["version"]), context.table[k].tolist()) for k in order for m in [context.ring[k]]])
        yield _frame(out, FOLDED).astype({"replaced_id": "Int64"})

    def close(self) -> None:
        pass


def stream_fold(candidates: DataFrame, *, merge: float = MERGE, gray: float = GRAY, cap: int = BUCKET_CAP) -> DataFrame:
    """Outcomes as fold.fold_candidates gives them, of a stream of candidates (project_id, context_hash, content_hash,
    arrival, id long, vec) whose contexts each arrive in order."""
    rows = candidates.select("project_id", "context_hash", "content_hash", F.col("arrival").cast("long").alias("arrival"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.groupBy("project_id", "context_hash").transformWithStateInPandas(statefulProcessor=Fold(merge, gray, cap), outputStructType=FOLDED, outputMode="append", timeMode="None")
