"""Directly-follows counts over a stream of events, kept up to date as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "object_id string, source string, target string, ts timestamp"


def _pairing(idle_ms: int | None):
    """The processor of one object's events. Its state is a list, to which events are added without reading what waits,
    and the last event that has been paired; a timer wakes it when the watermark has passed the first that waits."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Pairing(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "us long, event_seq long, event_type string")
            self.last = handle.getValueState("last", "event_type string, us long")

        def handleInputRows(self, key, rows, timerValues):
            past = timerValues.getCurrentWatermarkInMs()
            found = []
            for batch in rows:
                us = batch["ts"].astype("datetime64[us]").astype("int64")
                found += [(int(t), int(s), str(e)) for t, s, e in zip(us, batch["event_seq"], batch["event_type"], strict=True) if t > past * 1000]
            if found:
                self.waiting.appendList(found)
                self._wake(min(t for t, _, _ in found), past)
            return iter([])

        def _wake(self, us: int, past: int) -> None:
            self.handle.registerTimer(max(us // 1000 + 1, past + 1))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            past = timerValues.getCurrentWatermarkInMs()
            last = self.last.get() if self.last.exists() else None
            rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
            ready, rest = [r for r in rows if r[0] <= past * 1000], [r for r in rows if r[0] > past * 1000]
            if not ready:
                if not rest and last and idle_ms is not None and past * 1000 >= last[1] + idle_ms * 1000:
                    self.last.clear()  # quiet for so long that its next event is a new start
                return iter([])
            out, name, seen = [], last and last[0], last and last[1]
            for us, _, event in ready:
                if name is not None and idle_ms is not None and us >= seen + idle_ms * 1000:
                    name = None
                out.append((key[0], name or "START", event, pd.Timestamp(us, unit="us")))
                name, seen = event, us
            self.last.update((name, seen))
            if rest:
                self.waiting.put(rest)
                self._wake(rest[0][0], past)
            else:
                self.waiting.clear()
                if idle_ms is not None:
                    self._wake(seen + idle_ms * 1000, past)
            return iter([pd.DataFrame(out, columns=["object_id", "source", "target", "ts"])])

        def close(self) -> None:
            pass

    return Pairing()


def follow_stream(events: DataFrame, watermark: str = "1 hour", idle_ms: int | None = None) -> DataFrame:
    """From a stream of (object_id, event_type, ts, event_seq) the pairs of an object's successive events.

    Events wait until the watermark has passed them, so that late ones still find their place, and are then paired
    in order of (ts, event_seq); later ones are left out. State: an object's waiting events, each written once, and its
    last one, which is forgotten after ``idle_ms`` of event time without another: the next one then follows START.
    The state is RocksDB's, which lists and timers need; the session is set to it.
    """
    events.sparkSession.conf.set(PROVIDER, ROCKSDB)
    rows = events.select("object_id", "event_type", "ts", "event_seq").withWatermark("ts", watermark)
    return rows.groupBy("object_id").transformWithStateInPandas(_pairing(idle_ms), _OUT, "append", "EventTime")


def follow_counts(pairs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Weights of pairs by window of time, for a sink in update or complete mode."""
    return pairs.groupBy(F.window("ts", width), "source", "target").agg(F.count(F.lit(1)).alias("weight"))
