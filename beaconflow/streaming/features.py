"""Structured Streaming variants.

T1 keeps per-sender state across micro-batches with ``applyInPandasWithState``:
message count, the last values needed for lag differences, and running moments
(n, mean, M2) for the two consistency stds.  Senders are hashed into buckets; the senders of a
bucket share one state row of arrays and are advanced together, as whole columns, so
that a micro-batch costs one Python call for each bucket, not for each sender.  Two modes:

- order-key mode: a micro-batch's rows of one sender are sorted by the order key
  and continue the state (a message arriving after a later one of its sender in
  an earlier batch is not re-ordered);
- event-time mode (``event_time=..., delay=...``): the stream is watermarked,
  rows wait in state until the watermark passes them and are emitted in
  event-time order; an event-time timeout flushes quiet buckets.  Messages up to
  ``delay`` late are placed correctly.  Times are compared as epoch microseconds,
  so the session's time zone plays no part.  At the end of a finite run
  ``end_of_stream`` moves the watermark past the last rows.

Messages without a sender have no sequence: they pass through beside the state,
with position 0 and zero differences, as in the batch operator.

F12/F13 over the whole sender are not causal; the stream emits their running
value so far.  A bucket's rows of one micro-batch form one group (bounded by the
trigger size, e.g. ``maxFilesPerTrigger``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

_LAG = ["spdx", "spdy", "posx", "posy", "hedy"]
_BASE = ["posx", "posy", "posx_n", "spdx", "spdy", "hedy", "hedx_n"]
_OUT_SCHEMA = ("row_id long, senderpseudo long, posx double, posy double, posx_n double, spdx double, spdy double, "
               "hedy double, hedx_n double, sender_sequence long, inter_arrival_time double, "
               "speed_magnitude double, acceleration_x double, acceleration_y double, acceleration_magnitude double, "
               "position_change_x double, position_change_y double, position_change_magnitude double, "
               "heading_change double, heading_magnitude double, speed_consistency double, "
               "position_consistency double, hour long, night_hours int, speed_position_interaction double, "
               "inter_arrival_speed_ratio double")
#: Buckets of senders; a checkpoint goes on only with the number that it began with.
BUCKETS = 1024
_COUNTERS = ["sender", "n", *_LAG, "s_n", "s_mean", "s_m2", "p_n", "p_mean", "p_m2"]
_BUF_COLS = ["_s", "row_id", "_t", *_BASE]
_WHOLE = {"sender", "n", "s_n", "p_n", "_s", "row_id", "_t"}
_STATE_SCHEMA = ", ".join(f"{c} array<{'long' if c in _WHOLE else 'double'}>" for c in _COUNTERS)
_BUF_SCHEMA = ", ".join(f"b_{c} array<{'long' if c in _WHOLE else 'double'}>" for c in _BUF_COLS)


def _frame(columns: list[str], values) -> pd.DataFrame:
    """State arrays (None: nothing yet) as a frame with one row for each sender, or waiting message."""
    values = values if values is not None else [[]] * len(columns)
    return pd.DataFrame({c: np.array(v, np.int64 if c in _WHOLE else float) for c, v in zip(columns, values)})


def _running(vals: np.ndarray, code: np.ndarray, start: np.ndarray, n0: np.ndarray, mean0: np.ndarray, m20: np.ndarray):
    """Running (n, mean, M2) after each element (NaN skipped), continuing the prior (n, mean, M2) of its sender.

    ``code`` numbers the senders, whose elements begin at ``start``.  Vectorised: prefix moments of the batch
    combined with the prior state by the parallel-variance formula.
    """
    def so_far(x: np.ndarray) -> np.ndarray:
        return pd.Series(x).groupby(code, sort=False).cumsum(skipna=False).to_numpy()

    ok = ~np.isnan(vals)
    x = np.where(ok, vals, 0.0)
    m, s1 = so_far(ok.astype(np.int64)), so_far(x)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean_b = np.where(m > 0, s1 / np.maximum(m, 1), 0.0)
        last = np.concatenate([[0.0], mean_b[:-1]])
        last[start] = 0.0
        # exact prefix M2 via Welford-equivalent cumulative form
        m2_b = so_far(np.where(ok, (x - last) * (x - mean_b), 0.0))
        n0, mean0, m20 = n0[code], mean0[code], m20[code]
        n = n0 + m
        delta = mean_b - mean0
        m2 = m20 + m2_b + np.where(n > 0, delta * delta * n0 * m / np.maximum(n, 1), 0.0)
        mean = np.where(n > 0, (n0 * mean0 + s1) / np.maximum(n, 1), 0.0)
    return n, mean, m2


def _sequence(rows: pd.DataFrame, known: pd.DataFrame):
    """Advance the sequences of many senders over rows ordered by sender (``_s``) and then in time.

    ``known``: the counters of the senders seen before.  Returns (output frame, counters of all senders).
    """
    k = len(rows)
    sender, start, size = np.unique(rows["_s"].to_numpy(np.int64), return_index=True, return_counts=True)
    code = np.repeat(np.arange(len(sender)), size)
    before = known.set_index("sender").reindex(sender)
    prior = {c: before[c].fillna(0).to_numpy(np.int64 if c in _WHOLE else float) for c in _COUNTERS[1:] if c not in _LAG}
    cols = {c: rows[c].to_numpy(float) for c in _BASE}
    seq = prior["n"][code] + np.arange(k, dtype=np.int64) - np.repeat(start, size)
    spd = np.sqrt(cols["spdx"] ** 2 + cols["spdy"] ** 2)
    diffs = {}
    for c in _LAG:
        prev = np.concatenate([[np.nan], cols[c][:-1]])[:k]
        prev[start] = before[c].to_numpy(float)
        diffs[c] = np.nan_to_num(cols[c] - prev, nan=0.0)
    pcm = np.sqrt(diffs["posx"] ** 2 + diffs["posy"] ** 2)
    if k:
        sn, smean, sm2 = _running(spd, code, start, prior["s_n"], prior["s_mean"], prior["s_m2"])
        pn, pmean, pm2 = _running(pcm, code, start, prior["p_n"], prior["p_mean"], prior["p_m2"])
    else:
        sn = pn = np.zeros(0, np.int64)
        smean = sm2 = pmean = pm2 = np.zeros(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        s_std = np.where(sn > 1, np.sqrt(np.maximum(sm2, 0) / np.maximum(sn - 1, 1)), 0.0)
        p_std = np.where(pn > 1, np.sqrt(np.maximum(pm2, 0) / np.maximum(pn - 1, 1)), 0.0)
    spd0 = np.nan_to_num(spd, nan=0.0)
    hm = np.sqrt(cols["hedx_n"] ** 2 + cols["hedy"] ** 2)
    out = {"row_id": rows["row_id"].to_numpy(dtype=np.int64), "senderpseudo": sender[code], **cols,
           "sender_sequence": seq, "inter_arrival_time": np.ones(k), "speed_magnitude": spd0,
           "acceleration_x": diffs["spdx"], "acceleration_y": diffs["spdy"],
           "acceleration_magnitude": np.sqrt(diffs["spdx"] ** 2 + diffs["spdy"] ** 2),
           "position_change_x": diffs["posx"], "position_change_y": diffs["posy"],
           "position_change_magnitude": pcm, "heading_change": diffs["hedy"],
           "heading_magnitude": np.nan_to_num(hm, nan=0.0), "speed_consistency": s_std,
           "position_consistency": p_std, "hour": seq % 24, "night_hours": np.zeros(k, dtype=np.int32),
           "speed_position_interaction": np.nan_to_num(spd * pcm, nan=0.0),
           "inter_arrival_speed_ratio": np.nan_to_num(1.0 / (spd + 1e-6), nan=0.0)}
    if k:
        end = start + size - 1
        now = pd.DataFrame({"sender": sender, "n": prior["n"] + size, **{c: cols[c][end] for c in _LAG},
                            "s_n": sn[end], "s_mean": smean[end], "s_m2": sm2[end],
                            "p_n": pn[end], "p_mean": pmean[end], "p_m2": pm2[end]})
        others = known[~known["sender"].isin(sender)]
        known = pd.concat([others, now], ignore_index=True) if len(others) else now
    return pd.DataFrame(out), known


def _advance(key, pdfs, state):
    """Unbuffered mode: each micro-batch's rows of a bucket, by sender and in order-key order, continue its senders' state."""
    frames = [f for f in pdfs if len(f)]
    if not frames:
        return
    rows = pd.concat(frames, ignore_index=True).sort_values(["_s", "row_id"])
    out, counters = _sequence(rows, _frame(_COUNTERS, state.get if state.exists else None))
    state.update(tuple(counters[c].tolist() for c in _COUNTERS))
    yield out


def _advance_buffered(key, pdfs, state):
    """Event-time mode: rows wait in state until the watermark passes them, then are emitted, each sender's
    in (event time, order key) order; an event-time timeout flushes a quiet bucket."""
    frames = [f for f in pdfs if len(f)]
    held = state.get if state.exists else None
    known = _frame(_COUNTERS, held and held[:len(_COUNTERS)])
    wait = _frame(_BUF_COLS, held and held[len(_COUNTERS):])
    rows = pd.concat([wait, *[f.rename(columns={"_us": "_t"})[_BUF_COLS] for f in frames]], ignore_index=True) if frames else wait
    rows = rows.astype({c: "int64" if c in _WHOLE else "float64" for c in _BUF_COLS})
    wm = state.getCurrentWatermarkMs() * 1000
    ready = rows[rows["_t"] <= wm].sort_values(["_s", "_t", "row_id"])
    wait = rows[rows["_t"] > wm]
    out, known = _sequence(ready, known)
    state.update(tuple([*(known[c].tolist() for c in _COUNTERS), *(wait[c].tolist() for c in _BUF_COLS)]))
    if len(wait):
        state.setTimeoutTimestamp(int(wait["_t"].max()) // 1000 + 1)
    yield out


def _ship_by_value() -> None:
    """Pickle this module's functions with their code, so executors need no copy of the package."""
    import sys

    from pyspark import cloudpickle
    try:
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except ValueError:  # already registered
        pass


def stream_features(sdf: DataFrame, group: str = "senderpseudo", event_time: str | None = None,
                    delay: str = "30 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Per-sender sequence features on a stream of messages (append mode).

    Without ``event_time`` each micro-batch's rows continue their sender's state in
    order-key order (a message arriving after a later one of its sender is not
    re-ordered).  With ``event_time`` (a timestamp column) the stream is watermarked
    by ``delay``: rows are buffered in state until the watermark passes them and are
    emitted in event-time order, so messages up to ``delay`` late are placed
    correctly; buffered rows wait for the watermark (append-mode semantics).
    State is kept for ``buckets`` hash buckets of senders.
    """
    _ship_by_value()
    of_bucket = [F.pmod(F.xxhash64(F.col(group).cast("long")), F.lit(buckets)).alias("_bucket"), F.col(group).cast("long").alias("_s"), "row_id", *_BASE]
    cols = ["row_id", group, *_BASE]
    if event_time is None:
        src = sdf.select(*cols)
        sent, unsent = src.where(F.col(group).isNotNull()), src.where(F.col(group).isNull())
        seen = sent.select(*of_bucket).groupBy("_bucket").applyInPandasWithState(
            _advance, _OUT_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    else:
        src = sdf.withWatermark(event_time, delay).select(*cols, F.col(event_time).alias("_ts"), F.unix_micros(event_time).alias("_us"))
        # A message without event time cannot be placed in time order; it is left out of this mode.  The
        # filters look at the event time, so Spark keeps them above the watermark, which sees every row.
        of_sender = F.when(F.col(group).isNotNull(), F.col("_ts"))
        of_none = F.when(F.col(group).isNull() & F.col("row_id").isNotNull(), F.col("_ts"))
        sent, unsent = src.where(of_sender.isNotNull()), src.where(of_none.isNotNull())
        seen = sent.select(*of_bucket, "_ts", "_us").groupBy("_bucket").applyInPandasWithState(
            _advance_buffered, _OUT_SCHEMA, f"{_STATE_SCHEMA}, {_BUF_SCHEMA}", "append", GroupStateTimeout.EventTimeTimeout)
    seen = seen.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in _BASE else F.col(c) for c in seen.columns])
    return seen.unionByName(_without_sender(unsent, group, seen.columns))


def _without_sender(src: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """The features of messages that have no sender, a projection."""
    speed = F.sqrt(F.col("spdx") * F.col("spdx") + F.col("spdy") * F.col("spdy"))
    heading = F.sqrt(F.col("hedx_n") * F.col("hedx_n") + F.col("hedy") * F.col("hedy"))
    known = {"sender_sequence": F.lit(0).cast("long"), "hour": F.lit(0).cast("long"), "night_hours": F.lit(0), "inter_arrival_time": F.lit(1.0),
             "speed_magnitude": F.coalesce(speed, F.lit(0.0)), "heading_magnitude": F.coalesce(heading, F.lit(0.0)),
             "inter_arrival_speed_ratio": F.coalesce(F.lit(1.0) / (speed + F.lit(1e-6)), F.lit(0.0)),
             "senderpseudo": F.col(group).cast("long")}
    return src.select(*[known[c].alias(c) if c in known else F.col(c) if c in src.columns else F.lit(0.0).alias(c) for c in columns])


def end_of_stream(messages: DataFrame, event_time: str, delay: str) -> DataFrame:
    """A row without sender and id, later than all ``messages`` by more than ``delay``.

    Appended to the source of a finite run it moves the watermark past the rows that still wait; it
    yields no feature row itself.
    """
    last = messages.agg((F.max(event_time) + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 SECOND")).alias(event_time))
    return last.select(*[F.col(event_time) if f.name == event_time else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in messages.schema.fields])


def stream_scores(sdf: DataFrame, model, event_time: str | None = None, delay: str = "30 seconds") -> DataFrame:
    """Streaming features -> fitted pipeline -> class and probabilities (append mode)."""
    from ..plans.models import predict
    return predict(model, stream_features(sdf, event_time=event_time, delay=delay), ["row_id", "senderpseudo"])


def rate_windows(df: DataFrame, ts: str = "ts", width: str = "1 hour", group: str = "senderpseudo",
                 watermark: str | None = "10 minutes") -> DataFrame:
    """Messages per sender per tumbling window; works on a batch or a streaming frame.

    On a stream the watermark bounds the state kept for late messages.
    """
    src = df.withWatermark(ts, watermark) if watermark and df.isStreaming else df
    g = src.groupBy(F.window(ts, width).alias("w"), F.col(group)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.unix_seconds(F.col("w.start")).alias("window_start"), group, "n")
