"""Chained expiry: "the next one starts at the first event at or after the
current one's deadline" (F3 active timeout, R7 decision-cache TTL).

The rule is a sequential fold per key, but it can be evaluated without ever
holding a key's events in one task:

1. `next_after_deadline`: for every event i, the first event j of the same
   key with t_j >= deadline_i (strict: >) -- a sorted merge of events and
   deadline probes, evaluated per (key, time bucket) and stitched across
   buckets through a one-row-per-bucket summary.
2. `chain_members`: the chain root -> next -> next ... per key, found by
   pointer doubling: after round k every pointer jumps 2^k steps and the
   member set doubles; log2(chain length) rounds of uniform id joins. Each
   round is written to the shared checkpoint folder, so lineage stays short
   and lost executors cost at most one round.
3. `fill_forward`: every event takes the latest chain member at or before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import materialize


def _bucket(t: Column, width: int) -> Column:
    return F.floor(t / F.lit(width)).cast("bigint")


def next_after_deadline(df: DataFrame, key_cols: list[str], id_col: str, t_col: str, deadline: Column, *,
                        strict: bool = False, bucket_width: int = 3_600_000_000) -> DataFrame:
    """(key..., id, nxt): nxt = id of the first event (order t, id) of the
    same key with t >= deadline (t > deadline when strict); NULL if none."""
    ev = df.select(*key_cols, F.col(id_col).alias("_id"), F.col(t_col).alias("_t"), deadline.alias("_dl"))
    real = ev.select(*key_cols, F.col("_t").alias("_pt"), F.lit(1).alias("_typ"), F.col("_id").alias("_rid"),
                     F.lit(None).cast(ev.schema["_id"].dataType).alias("_qid"))
    probe_typ = 2 if strict else 0
    probes = ev.select(*key_cols, F.col("_dl").alias("_pt"), F.lit(probe_typ).alias("_typ"),
                       F.lit(None).cast(ev.schema["_id"].dataType).alias("_rid"), F.col("_id").alias("_qid"))
    u = real.unionByName(probes).withColumn("_b", _bucket(F.col("_pt"), bucket_width))
    # backwards: a frame that grows keeps its last value, one that shrinks (current row to the end) is read again
    # for every row
    order = [F.col(c).desc() for c in ("_pt", "_typ", "_rid")]
    w_after = Window.partitionBy(*key_cols, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding,
                                                                               Window.currentRow)
    u = u.withColumn("_next_local", F.last(F.when(F.col("_typ") == 1, F.struct("_pt", "_rid")),
                                           ignorenulls=True).over(w_after))
    # first real event of every (key, bucket) -- over all buckets that hold a
    # real event or a probe -- carried back to earlier buckets
    firsts = real.withColumn("_b", _bucket(F.col("_pt"), bucket_width)).groupBy(*key_cols, "_b") \
        .agg(F.min(F.struct("_pt", "_rid")).alias("_first_real"))
    allb = u.select(*key_cols, "_b").distinct().join(firsts, on=[*key_cols, "_b"], how="left")
    w_later = Window.partitionBy(*key_cols).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summ_full = allb.select(*key_cols, "_b", F.last("_first_real", ignorenulls=True).over(w_later).alias("_carry"))
    pb = u.where(F.col("_typ") != 1).select(*key_cols, "_b", "_qid", "_next_local")
    out = pb.join(summ_full, on=[*key_cols, "_b"], how="left")
    nxt = F.coalesce(F.col("_next_local"), F.col("_carry"))
    return out.select(*key_cols, F.col("_qid").alias(id_col), nxt["_rid"].alias("nxt"))


def chain_members(nodes: DataFrame, roots: DataFrame, id_col: str = "id", *, checkpoint: bool = True,
                  max_rounds: int = 64) -> DataFrame:
    """Ids reachable from `roots` by following `nxt` (pointer doubling).

    nodes: (id, nxt); roots: (id). Returns (id) of every chain member."""
    spark = nodes.sparkSession
    jump = nodes.select(F.col(id_col).alias("_src"), F.col("nxt").alias("_dst")).where(F.col("_dst").isNotNull())
    members = roots.select(F.col(id_col).alias("_m")).distinct()

    def cut(df: DataFrame) -> DataFrame:
        return materialize(df, "chain") if checkpoint else df.cache()

    jump, members = cut(jump), cut(members)
    for _ in range(max_rounds):
        if jump.limit(1).count() == 0:
            break
        reached = members.join(jump, members["_m"] == jump["_src"], "inner").select(F.col("_dst").alias("_m"))
        members = cut(members.unionByName(reached).distinct())
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut(a.join(b, F.col("a._dst") == F.col("b._src"), "inner")
                   .select(F.col("a._src").alias("_src"), F.col("b._dst").alias("_dst")))
    else:
        raise RuntimeError("chain longer than 2**max_rounds")
    del spark
    return members.select(F.col("_m").alias(id_col))


def fill_forward(df: DataFrame, key_cols: list[str], order: Column, value: Column, *, t_col: str,
                 bucket_width: int = 3_600_000_000, name: str = "filled") -> DataFrame:
    """Latest non-NULL `value` at or before each row in its key (order by
    `order`), per (key, time bucket) with a carried value from earlier
    buckets."""
    d = df.withColumn("_o", order).withColumn("_v", value).withColumn("_b", _bucket(F.col(t_col), bucket_width))
    w = Window.partitionBy(*key_cols, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_loc", F.last("_v", ignorenulls=True).over(w))
    summ = d.where(F.col("_v").isNotNull()).groupBy(*key_cols, "_b").agg(F.max_by("_v", "_o").alias("_lastv"))
    ws = Window.partitionBy(*key_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    allb = d.select(*key_cols, "_b").distinct().join(summ, on=[*key_cols, "_b"], how="left")
    carry = allb.select(*key_cols, "_b", F.last("_lastv", ignorenulls=True).over(ws).alias("_carry"))
    return d.join(carry, on=[*key_cols, "_b"], how="left") \
        .withColumn(name, F.coalesce("_loc", "_carry")).drop("_o", "_v", "_b", "_loc", "_carry")


# ------------------------------------------------------------------ R7
TTL_LOW_RISK_S = 3600
TTL_OTHER_S = 300
LOW_RISK_BELOW = 20


def decision_cache(requests: DataFrame, *, key_cols=("src", "dst", "dst_port"), id_col: str = "id",
                   ts_col: str = "ts", risk_col: str = "risk", low_ttl_s: int = TTL_LOW_RISK_S,
                   other_ttl_s: int = TTL_OTHER_S, low_below: int = LOW_RISK_BELOW,
                   checkpoint: bool = True) -> DataFrame:
    """Replay requests through the decision cache.

    A miss scores the request and writes the result with a TTL chosen by
    that score (3600 s when risk < 20, else 300 s); a later request of the
    same key is a hit while t - t_write < TTL; hits never extend the entry;
    the first request at or after expiry is the next miss. Output: every
    request with `cached`, the risk served, and the writing request's id."""
    key = list(key_cols)
    r = requests.withColumn("_t", F.unix_micros(F.col(ts_col).cast("timestamp")))
    ttl_us = F.when(F.col(risk_col) < low_below, F.lit(low_ttl_s * 1_000_000)).otherwise(F.lit(other_ttl_s * 1_000_000))
    nodes = next_after_deadline(r, key, id_col, "_t", F.col("_t") + ttl_us)
    roots = r.groupBy(*key).agg(F.min(F.struct("_t", id_col)).alias("_r")).select(F.col(f"_r.{id_col}").alias(id_col))
    misses = chain_members(nodes.select(id_col, "nxt"), roots, id_col, checkpoint=checkpoint) \
        .withColumn("_miss", F.lit(True))
    m = r.join(misses, on=id_col, how="left").withColumn("cached", F.col("_miss").isNull())
    writer = F.when(~F.col("cached"), F.struct(F.col(id_col).alias("writer_id"), F.col(risk_col).alias("served_risk")))
    f = fill_forward(m, key, F.struct("_t", id_col), writer, t_col="_t", name="_w")
    return f.select(*requests.columns, "cached", F.col("_w.writer_id").alias("writer_id"),
                    F.col("_w.served_risk").alias("served_risk"))


# ------------------------------------------------------------------ F3
def active_split(sessions: DataFrame, active_timeout: float = 1800.0, *, key_cols: list[str],
                 strict: bool = False, checkpoint: bool = True) -> DataFrame:
    """Split idle-gap flows at the active timeout (F3): a flow ends when a
    packet arrives at or after start + active_timeout (strict: after), and
    that packet starts the next flow -- so boundaries chain. Only flows
    longer than the timeout need the chain; the rest keep sub-flow 0.
    Adds `sub` = id (packet_no) of the sub-flow's first packet."""
    act = int(round(active_timeout * 1_000_000))
    span = sessions.groupBy(*key_cols).agg((F.max("ts_us") - F.min("ts_us")).alias("_span"))
    long_keys = span.where(F.col("_span") >= act).select(*key_cols)
    longp = sessions.join(long_keys, on=key_cols, how="left_semi")
    shortp = sessions.join(long_keys, on=key_cols, how="left_anti")
    nodes = next_after_deadline(longp, key_cols, "packet_no", "ts_us", F.col("ts_us") + F.lit(act), strict=strict)
    roots = longp.groupBy(*key_cols).agg(F.min(F.struct("ts_us", "packet_no")).alias("_r")) \
        .select(F.col("_r.packet_no").alias("packet_no"))
    starts = chain_members(nodes.select("packet_no", "nxt"), roots, "packet_no", checkpoint=checkpoint) \
        .withColumn("_start", F.lit(True))
    lp = longp.join(starts, on="packet_no", how="left")
    lp = fill_forward(lp, key_cols, F.struct("ts_us", "packet_no"),
                      F.when(F.col("_start").isNotNull(), F.col("packet_no")), t_col="ts_us", name="sub").drop("_start")
    first_pkt = shortp.groupBy(*key_cols).agg(F.min(F.struct("ts_us", "packet_no")).alias("_f"))
    sp = shortp.join(first_pkt, on=key_cols, how="inner").withColumn("sub", F.col("_f.packet_no")).drop("_f")
    return lp.unionByName(sp)
