"""Event-time windows and ordered recurrences, over batch or streaming tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """``events`` with ``ts`` as a zoned time, under a watermark when ``late`` is given."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late else out


def window_totals(events: DataFrame, by: str, size: str, slide: str | None = None) -> DataFrame:
    """(by, start, n, total) over tumbling or sliding windows."""
    over = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(by, over.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(by, F.col("w.start").alias("start"), "n", "total")


def session_totals(events: DataFrame, by: str, gap: str) -> DataFrame:
    """(by, start, n, total) over sessions that ``gap`` without an event ends."""
    return events.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(by, F.col("w.start").alias("start"), "n", "total")


def running_frames(events: DataFrame, by: str) -> DataFrame:
    """(by, frame, first, change): each event of a stream as a frame that differs from the one before; the first is a key frame.

    Works on a streaming table: the state of a key is its frame count and its last
    value. Events of one micro-batch are taken in time order.
    """
    kind = dict(events.dtypes)[by]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for value in rows["value"]:
            out.append((key[0], n, n == 0, float(value) - (last if n else 0.0)))
            n, last = n + 1, float(value)
        state.update((n, last))
        yield pd.DataFrame(out, columns=[by, "frame", "first", "change"])

    return events.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, frame long, first boolean, change double", "n long, last double", "append", GroupStateTimeout.NoTimeout)


def written_stream(out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """``out``, a streaming table, run over all that is there and written as Parquet to ``path``, then read back as a batch table."""
    run = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)


def decoded_requests(requests: DataFrame, buckets: int = 1024) -> DataFrame:
    """(stream_id, i, sym) of a streaming or batch table of ``requests`` (stream_id, seq, n, bounds, low, stream): symbols of coded streams, asked for bit by bit.

    The first request of a stream brings its bytes; the state of a stream is those
    that aren't read yet and the coder's place, so later requests go on where the
    last one ended. Where requests have a column ``last``, a stream's state goes
    with the request for which it is true: else state grows with all streams that
    there ever were. Streams share ``buckets`` rows of state by hash, as a group of
    its own for each small stream costs far more than its symbols; symbols go out
    some at a time.
    """
    from ..operators.coder import LANES, Decoder

    kind, told_last = dict(requests.dtypes)["stream_id"], "last" in requests.columns
    columns = ["stream_id", "seq", "n", "low", "bounds", "stream", *["last"] * told_last]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {k: rest for k, *rest in zip(*state.get, strict=True)} if state.exists else {}
        told = [r for f in frames for r in zip(*(f[c].tolist() for c in columns), strict=True)]
        names, places, symbols, size = [], [], [], 0
        for name, _, n, low, bounds, brought, *last in sorted(told, key=lambda r: r[:2]):
            if name not in kept and brought is None:
                raise ValueError(f"a request of stream {name} without its bytes")
            stream, x, done = kept.get(name, (brought, 0, 0))
            coder = Decoder(stream := bytes(stream), (int(x), 0) if x else None)
            found = coder.take(int(n), np.asarray(bounds).tolist(), int(low))
            if last and last[0]:
                kept.pop(name, None)
            else:
                kept[name] = stream[4 * coder.at :], coder.state, done + len(found)
            names.append(np.full(len(found), name, dtype=object))
            places.append(np.arange(done, done + len(found)))
            symbols.append(np.array(found, dtype=np.int64))
            size += len(found)
            if size >= LANES:
                yield pd.DataFrame({"stream_id": np.concatenate(names), "i": np.concatenate(places), "sym": np.concatenate(symbols)})
                names, places, symbols, size = [], [], [], 0
        if kept:
            state.update(tuple(list(c) for c in zip(*((k, *own) for k, own in kept.items()), strict=True)))
        elif state.exists:
            state.remove()
        if names:
            yield pd.DataFrame({"stream_id": np.concatenate(names), "i": np.concatenate(places), "sym": np.concatenate(symbols)})

    dealt = requests.withColumn("_bucket", F.pmod(F.xxhash64("stream_id"), F.lit(buckets)))
    held = f"stream_id array<{kind}>, stream array<binary>, x array<long>, done array<long>"
    return dealt.groupBy("_bucket").applyInPandasWithState(step, f"stream_id {kind}, i long, sym long", held, "append", GroupStateTimeout.NoTimeout)
