"""Structured Streaming: loss accounting and running energy per node, deduplication, fan-out to sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATE = "last bigint, n bigint, mean double, m2 double"
_TRACKED = "node_id bigint, seq bigint, ts_us bigint, lost bigint, late boolean, energy double, energy_z double"


def track(frames: DataFrame, timeout_ms: int | None = 86_400_000) -> DataFrame:
    """(node_id, seq, ts_us, lost, late, energy, energy_z) of a stream of frames with an ``energy`` column.

    Per node: frames lost since the last one (modulo 2^32; a step back is late, not lost) and the z of
    the energy against all so far, itself included. The state is four numbers a node and is dropped
    after ``timeout_ms`` without frames (None: never; a query that is to end by itself needs None). Within a micro-batch frames go by seq time (ts_us).
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n, mean, m2 = state.get if state.exists else (None, 0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts_us", "seq"], kind="stable")
        out = []
        for seq, ts, e in zip(rows["seq"], rows["ts_us"], rows["energy"]):
            gap = 0 if last is None else (int(seq) - last - 1) % (1 << 32)
            late = gap >= 1 << 31
            if not late:
                last = int(seq)
            z = None
            if e == e and e is not None:
                n += 1
                d = e - mean
                mean += d / n
                m2 += d * (e - mean)
                sd = (m2 / n) ** 0.5 if n > 1 and m2 > 0 else 1.0
                z = (e - mean) / sd
            out.append((key[0], int(seq), int(ts), 0 if late else gap, late, e, z))
        state.update((last, n, mean, m2))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["node_id", "seq", "ts_us", "lost", "late", "energy", "energy_z"])

    live = frames.filter("node_id is not null and seq is not null and ts_us is not null").select("node_id", "seq", "ts_us", F.col("energy").cast("double").alias("energy"))
    return live.groupBy("node_id").applyInPandasWithState(step, _TRACKED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms is not None else GroupStateTimeout.NoTimeout)


def first_deliveries(frames: DataFrame, arrival: str = "received_at", within: str = "2 days") -> DataFrame:
    """The stream without repeated (node_id, seq, ts_us) that arrive within the watermark; exact times only.

    Jittered device times are settled by the batch operator ``operators.dedup`` on the stored table.
    """
    return frames.withWatermark(arrival, within).dropDuplicatesWithinWatermark(["node_id", "seq", "ts_us"])


def windowed(frames: DataFrame, time: str, keys: Sequence[str], length: str, hop: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and mean energy per event-time window, late rows taken in up to the watermark."""
    w = F.window(time, length, hop) if hop else F.window(time, length)
    return frames.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.avg("energy").alias("energy"))


def fan_out(stream: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str, once: bool = False):
    """Start the query: every micro-batch goes to every sink, written once and cached for them."""
    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, epoch)
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
