"""Flows from a live packet stream, with idle and active timeouts.

Per key (endpoints and protocol) the state is one running flow: its bounds, the
last packet of each direction, and counts, sums and sums of squares from which
all columns of F5-F10 follow. Packets are replayed in event time (see `replay`);
a flow ends where a gap is longer than the idle timeout, at the first packet at
or after its start + the active timeout (which starts the next one, so the
boundaries chain), or when the idle timeout has passed in event time. The
finished moments become columns by the same expressions as in batch.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators import flows as fl
from flowlens.streaming.replay import EventTimeReplay

_FLAGS = ["syn", "ack", "fin", "rst", "psh"]
#: name -> type of a flow's running values, in the names of `flows.flow_aggregates`
MOMENTS = {
    "start_us": "long", "first_packet": "long", "_last_us": "long", "_fwd_us": "long", "_bwd_us": "long",
    "packet_count_fwd": "long", "packet_count_bwd": "long", "byte_count_fwd": "long", "byte_count_bwd": "long",
    "packet_length_min": "long", "packet_length_max": "long", "_len_n": "long", "_len_s1": "long", "_len_s2": "decimal(38,0)",
    **{f"_{g}_{s}": "decimal(38,0)" if s == "s2" else "long" for g in ("gf", "gb", "gt") for s in ("n", "s1", "s2")},
    "_gmin": "long", "_gmax": "long", **{f"{f}_flag_count": "long" for f in _FLAGS},
    "_ttl_n": "long", "_ttl_s1": "long", "_win_n": "long", "_win_s1": "long",
}
_NAMES = list(MOMENTS)


def _square_sum(x: np.ndarray) -> int:
    """Exact sum of squares of numbers up to 2^40."""
    high, low = x >> 20, x & ((1 << 20) - 1)
    return (int((high * high).sum()) << 40) + (int((high * low).sum()) << 21) + int((low * low).sum())


def _least(a, b, pick):
    return a if b is None else b if a is None else pick(a, b)


class ActiveFlows(EventTimeReplay):
    fields = {"t_us": "long", "packet_no": "long", "is_fwd": "boolean", "pkt_len": "long", "flags": "long",
              "ttl": "long", "win": "long"}
    order = ["t_us", "packet_no"]
    entry = ", ".join(f"{c} {t}" for c, t in MOMENTS.items())

    def __init__(self, idle_us: int, active_us: int, width_ms: int = 1000):
        self.idle_us, self.active_us, self.width_ms = idle_us, active_us, width_ms
        self.hold_us = idle_us + 1

    def expiry_us(self, entry: tuple) -> int:
        return int(entry[_NAMES.index("_last_us")]) + self.idle_us + 1

    def expire(self, key, entry):
        return self._rows(key, [entry])

    def _rows(self, key: tuple, entries: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(entries, columns=_NAMES)
        return pd.concat([pd.DataFrame([key] * len(out), columns=fl.KEY), out], axis=1)

    def _grown(self, entry: tuple | None, rows: pd.DataFrame, tcp: bool) -> tuple:
        """The flow with some more packets."""
        t, length, fwd = rows["t_us"].to_numpy(), rows["pkt_len"].to_numpy(), rows["is_fwd"].to_numpy().astype(bool)
        m = dict(zip(_NAMES, entry)) if entry else dict.fromkeys(_NAMES, 0) | {
            "start_us": int(t[0]), "first_packet": int(rows["packet_no"].iloc[0]), "_fwd_us": None, "_bwd_us": None,
            "packet_length_min": None, "packet_length_max": None, "_gmin": None, "_gmax": None}
        for side, mine, last in (("fwd", fwd, "_fwd_us"), ("bwd", ~fwd, "_bwd_us")):
            at, name = t[mine], "gf" if side == "fwd" else "gb"
            m[f"packet_count_{side}"] += len(at)
            m[f"byte_count_{side}"] += int(length[mine].sum())
            gaps = np.diff(at if m[last] is None else np.concatenate(([m[last]], at)))
            if len(gaps):
                for g in (name, "gt"):
                    m[f"_{g}_n"] += len(gaps)
                    m[f"_{g}_s1"] += int(gaps.sum())
                    m[f"_{g}_s2"] = int(m[f"_{g}_s2"]) + _square_sum(gaps)
                m["_gmin"] = _least(m["_gmin"], int(gaps.min()), min)
                m["_gmax"] = _least(m["_gmax"], int(gaps.max()), max)
            if len(at):
                m[last] = int(at[-1])
        m["packet_length_min"] = _least(m["packet_length_min"], int(length.min()), min)
        m["packet_length_max"] = _least(m["packet_length_max"], int(length.max()), max)
        m["_len_n"] += len(length)
        m["_len_s1"] += int(length.sum())
        m["_len_s2"] = int(m["_len_s2"]) + _square_sum(length)
        m["_last_us"] = int(t[-1])
        for f in _FLAGS:
            m[f"{f}_flag_count"] += int(((rows["flags"].to_numpy() & fl.TCP_FLAG_BITS[f]) != 0).sum()) if tcp else 0
        ttl, win = rows["ttl"].to_numpy(), rows["win"].to_numpy()
        m["_ttl_n"] += len(ttl)
        m["_ttl_s1"] += int(ttl.sum())
        m["_win_n"] += int((win != 0).sum()) if tcp else 0
        m["_win_s1"] += int(win.sum()) if tcp else 0
        return tuple(Decimal(int(m[c])) if c.endswith("_s2") else m[c] for c in _NAMES)

    def replay(self, key, rows, entry):
        t, tcp, done = rows["t_us"].to_numpy(), key[4] == fl.TCP, []
        last = None if entry is None else int(entry[_NAMES.index("_last_us")])
        wide = np.zeros(len(t), bool)
        wide[1:] = np.diff(t) > self.idle_us
        wide[0] = last is not None and t[0] - last > self.idle_us
        breaks = np.flatnonzero(wide)
        i = 0
        while i < len(t):  # a turn for each flow
            if entry is not None and (wide[i] or t[i] >= entry[0] + self.active_us):
                done.append(entry)
                entry = None
            start = int(t[i]) if entry is None else int(entry[0])
            k = int(np.searchsorted(breaks, i, "right"))
            j = min(int(np.searchsorted(t, start + self.active_us, "left")), int(breaks[k]) if k < len(breaks) else len(t))
            entry = self._grown(entry, rows.iloc[i:j], tcp)
            i = j
        return (self._rows(key, done) if done else None), entry


def flow_stream(packets: DataFrame, *, idle_timeout: float = 120.0, active_timeout: float = 1800.0,
                key: str = "ip", watermark: str = "1 minute", width_ms: int = 1000) -> DataFrame:
    """Finished flows (all columns of `flows.flow_stats`, and first_packet) of a
    packet stream, `append` mode. Fields of a packet that may be null count as 0."""
    p = packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", watermark)
    k = fl.canonical_key(p, key).select(
        *fl.KEY, "ts", F.col("ts_us").alias("t_us"), "packet_no", "is_fwd",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("pkt_len", "flags", "ttl", "win")])
    keys = {f.name: f.dataType.simpleString() for f in k.schema.fields if f.name in fl.KEY}
    schema = ", ".join(f"{c} {t}" for c, t in ({c: keys[c] for c in fl.KEY} | MOMENTS).items())
    flows = ActiveFlows(int(round(idle_timeout * fl.US)), int(round(active_timeout * fl.US)), width_ms)
    m = k.groupBy(*fl.KEY).transformWithStateInPandas(flows, schema, outputMode="Append", timeMode="EventTime")
    n = {c: F.col(f"_{c}_s1") / F.when(F.col(f"_{c}_n") > 0, F.col(f"_{c}_n")) for c in ("ttl", "win")}
    m = m.withColumns({
        "sid": F.struct(F.col("start_us").alias("ts_us"), F.col("first_packet").alias("n")),
        "packet_count_total": F.col("packet_count_fwd") + F.col("packet_count_bwd"), "_ttl": n["ttl"], "_win": n["win"]})
    return fl.flow_columns(m, [*fl.KEY, "first_packet"])
