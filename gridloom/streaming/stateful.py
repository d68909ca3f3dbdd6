"""Stateful streams: online combination weights kept by key, and answers to requests by kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.recursive import State

STATE = "w array<double>, p array<double>, n long, mean double, squares double, tails double"


def updated(state: tuple | None, x: np.ndarray, y: np.ndarray, forget: float = 0.99) -> tuple:
    """Recursive least squares weights on the simplex after more rows in order."""
    k = x.shape[1]
    w, p, n, mean, squares = (np.full(k, 1 / k), np.eye(k) * 1e-4, 0, 0.0, 0.0) if state is None else (np.array(state[0]), np.array(state[1]).reshape(k, k), *state[2:])
    for a, b in zip(x, y, strict=True):
        e = b - a @ w
        gain = p @ a / (forget + a @ p @ a)
        w = np.maximum(w + gain * e, 0)
        w = w / w.sum() if w.sum() > 0 else np.full(k, 1 / k)
        p = (p - np.outer(gain, a @ p)) / forget
        n += 1
        off = e - mean
        mean += off / n
        squares += off * (e - mean)
    return w.tolist(), p.ravel().tolist(), n, float(mean), float(squares)


def online_weights(stream: DataFrame, key: str, time: str, methods: list[str], forget: float | None = 0.99) -> DataFrame:
    """A row of weights for each key and micro-batch that has rows of it; the state goes on from batch to batch and outlives restarts by the query's checkpoint. forget None: the adaptive factor of `recursive`, whose weights after all batches are those of one pass over all rows."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([time, "y", *methods])
        x, y = rows[methods].to_numpy(float), rows["y"].to_numpy(float)
        if forget is None:
            new = _unpacked(state.get, len(methods)) if state.exists else State.first(len(methods))
            new.update(x, y)
            packed = (new.w.tolist(), new.p.ravel().tolist(), new.n, float(new.mean), float(new.squares), float(new.tails))
        else:
            packed = (*updated(tuple(state.get)[:5] if state.exists else None, x, y, forget), 0.0)
        state.update(packed)
        yield pd.DataFrame({key: [k[0]], "n": [packed[2]], "weights": [packed[0]]})

    rows = stream.select(key, time, "y", *methods).dropna()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, weights array<double>", STATE, "append", GroupStateTimeout.NoTimeout)


def _unpacked(state: tuple, k: int) -> State:
    w, p, n, mean, squares, tails = state
    return State(np.array(w, float), np.array(p, float).reshape(k, k), n, mean, squares, tails)


def dispatched(batch: DataFrame, consumers: dict[str, Callable[[DataFrame], DataFrame]], late: int | None = None, now: int | None = None) -> DataFrame:
    """Answers (correlation_id, reply_to, status, body) of a batch of requests (consumer_name, correlation_id, reply_to, sent, static_data): each consumer gets its own requests at once; unknown consumers and requests older than `late` seconds are answered by a status."""
    ok = F.lit(True) if late is None else F.col("sent") >= (now - late)
    known = F.col("consumer_name").isin(*consumers)
    bad = batch.filter(~(known & ok)).select("correlation_id", "reply_to", F.when(~known, "unknown consumer").otherwise("too late").alias("status"), F.lit(None).cast("string").alias("body"))
    for name, f in sorted(consumers.items()):
        asked = batch.filter((F.col("consumer_name") == name) & ok)
        bad = bad.union(f(asked).select("correlation_id", "reply_to", F.lit("done").alias("status"), F.col("body").cast("string")))
    return bad


PENDING = "asked timestamp, reply_to string, body string"


def matched(requests: DataFrame, replies: DataFrame, wait: str, late: str = "0 seconds") -> DataFrame:
    """An answer to every request of a stream (correlation_id, reply_to, sent) from a stream of replies (correlation_id, body, at): correlation_id, reply_to, status, body.

    A request waits in the state, by its id, until a reply comes (`done`), or until the event time, which `late` rows may
    lag behind, has passed `wait` since it was sent (`timeout`); either ends it. A reply that comes before its request
    waits for it as long. A reply to no pending request, one that comes after its time-out, and one that comes again, is
    given as `unclaimed`. What waits outlives restarts by the query's checkpoint.
    """
    asks = requests.select("correlation_id", F.lit(True).alias("asks"), "reply_to", F.lit(None).cast("string").alias("body"), F.col("sent").alias("at"))
    gives = replies.select("correlation_id", F.lit(False).alias("asks"), F.lit(None).cast("string").alias("reply_to"), "body", "at")
    both = asks.union(gives).withWatermark("at", late)
    ms = int(pd.Timedelta(wait).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            asked, reply_to, body = state.get
            out.append((key[0], reply_to, "timeout" if asked is not None else "unclaimed", body))
            state.remove()
        else:
            asked = reply_to = body = since = None
            if state.exists:
                asked, reply_to, body = state.get
            rows = pd.concat(list(batches)).sort_values(["at", "asks"], ascending=[True, False])
            for r in rows.itertuples():
                if r.asks and asked is None:
                    asked, reply_to = r.at, r.reply_to
                    if body is not None:  # its reply came first
                        out.append((key[0], reply_to, "done", body))
                        asked = reply_to = body = None
                elif not r.asks:
                    if asked is not None and (r.at - pd.Timestamp(asked)) <= pd.Timedelta(wait):
                        out.append((key[0], reply_to, "done", r.body))
                        asked = reply_to = body = None
                    elif asked is not None:  # too late
                        out += [(key[0], reply_to, "timeout", None), (key[0], None, "unclaimed", r.body)]
                        asked = reply_to = body = None
                    else:
                        if body is not None:
                            out.append((key[0], None, "unclaimed", r.body))
                        else:
                            body = r.body
                since = r.at
            if asked is None and body is None:
                if state.exists:
                    state.remove()
            else:
                state.update((asked, reply_to, body))
                end = int(pd.Timestamp(asked if asked is not None else since).timestamp() * 1000) + ms
                state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["correlation_id", "reply_to", "status", "body"])

    kind = dict(requests.dtypes)["correlation_id"]
    return both.groupBy("correlation_id").applyInPandasWithState(step, f"correlation_id {kind}, reply_to string, status string, body string", PENDING, "append", GroupStateTimeout.EventTimeTimeout)


def serve(requests: DataFrame, consumers: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str, late: int | None = None):
    """Answer a stream of requests into JSON files; a batch that is run again after a failure overwrites its own answers."""

    def write(batch: DataFrame, number: int) -> None:
        import time

        dispatched(batch, consumers, late, int(time.time())).write.mode("overwrite").json(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback(series: DataFrame, keys: list[str], time: str, y: str, lags: list[int], steps: int, model, start: int) -> DataFrame:
    """Forecasts of `steps` times after `start` of any model over lags, each fed back as a later one's lag: keys, time, y_hat.

    One grouped pass gathers each key's last max(lags) values (of several at one time the largest); from there on no row
    leaves its task. model: SQL text over lag_0, lag_1, ... (one projection, whatever the number of steps), a `Vectors`
    function (one Arrow pass), or a function from a frame with these columns to a Column (a projection a step). A lag
    that is null or was never observed gives null, as long as the model does.
    """
    ring = _rings(series, keys, time, y, max(lags), start)
    if isinstance(model, Vectors):
        return ring.mapInArrow(_recursion(keys, max(lags), list(lags), steps, model.f, start), _forecast_schema(ring, keys, time))
    size = max(lags)
    if isinstance(model, str):
        one = f"array(CAST({model} AS DOUBLE))"
        for i in reversed(range(len(lags))):  # each lag is the variable of a lambda around the model
            one = f"flatten(transform(array(element_at(h, {-lags[i]})), lag_{i} -> {one}))"
        h = F.expr(f"aggregate(sequence(1, {int(steps)}), ring, (h, s) -> concat(h, {one}))")
    else:
        frame = ring
        for _ in range(steps):
            wide = frame.select(*keys, "ring", *[F.element_at("ring", -l).alias(f"lag_{i}") for i, l in enumerate(lags)])
            frame = wide.select(*keys, F.concat("ring", F.array(model(wide).cast("double"))).alias("ring"))
        ring, h = frame, F.col("ring")
    made = ring.select(*keys, F.posexplode(F.slice(h, size + 1, steps)).alias("__at", "y_hat")) if steps else ring.select(*keys, F.lit(0).alias("__at"), F.lit(None).cast("double").alias("y_hat")).limit(0)
    return made.select(*keys, (F.lit(start + 1).cast("long") + F.col("__at")).alias(time), "y_hat")


class Vectors:
    """Marks a model that takes a numpy matrix (rows by lags) and gives a vector."""

    def __init__(self, f: Callable[[np.ndarray], np.ndarray]):
        self.f = f


def _rings(series: DataFrame, keys: list[str], time: str, y: str, size: int, start: int) -> DataFrame:
    """keys and ring: the values at start - size + 1, ... start, null where there are none; size values a key at most, whatever the series' length."""
    last = series.filter((F.col(time) <= start) & (F.col(time) > start - size)).select(*keys, (F.col(time) - (start - size + 1)).cast("int").alias("__at"), F.col(y).cast("double").alias("__y"))
    last = last.groupBy(*keys, "__at").agg(F.max("__y").alias("__y")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__at", "__y"))).alias("__m"))
    return last.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.element_at("__m", k)).alias("ring"))


def _forecast_schema(ring: DataFrame, keys: list[str], time: str):
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    return StructType([ring.schema[k] for k in keys] + [StructField(time, LongType()), StructField("y_hat", DoubleType())])


def _recursion(keys: list[str], size: int, lags: list[int], steps: int, f: Callable, start: int):
    """All steps of a batch of keys, side by side."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            h = np.full((n, size + steps), np.nan)
            h[:, :size] = np.array(batch.column("ring").flatten().to_numpy(zero_copy_only=False), float).reshape(n, size)
            for s in range(steps):
                x = h[:, [size + s - l for l in lags]]
                on = ~np.isnan(x).any(1)  # a model need not know of missing values
                if on.any():
                    h[on, size + s] = np.asarray(f(x[on]), float)
            row = pa.array(np.repeat(np.arange(n), steps))
            y = h[:, size:].ravel()
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in keys), pa.array(np.tile(start + 1 + np.arange(steps), n)), pa.array(y, mask=np.isnan(y))], schema=pa.schema([*(batch.schema.field(k) for k in keys), pa.field("t", pa.int64()), pa.field("y_hat", pa.float64())]))

    return run
