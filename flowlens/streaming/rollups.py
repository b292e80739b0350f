"""Live rollups of scored decisions and streaming flow operators (R1-R6,
R8-R10).

Every function takes a DataFrame and returns one, and works unchanged on a
batch DataFrame or a streaming one (`spark.readStream...`): the batch form
is the oracle for the streaming form. Event time is the `ts` column; late
rows are dropped once the watermark has passed them (a stated semantics --
the reference's dashboards count on wall-clock arrival).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators import score as sc

# fixed values (R5): latency histogram upper bounds in ms (plus +Inf)
LATENCY_BUCKETS_MS = [10, 25, 50, 100, 250, 500, 1000]
NOT_DEANONYMISED = ["UNKNOWN", "VPN"]


def decision_events(scored: DataFrame, *, risk_col: str = "risk", app_col: str = "app_class") -> DataFrame:
    """Scored requests -> decision events: action (M2), flow type, deanonymised
    flag (class not in UNKNOWN / VPN) (R9). Stateless: one output per input."""
    action, _ = sc.policy(F.col(risk_col))
    return scored.withColumns({
        "action": action,
        "flow_type": F.col(app_col),
        "deanonymised": ~F.coalesce(F.col(app_col), F.lit("UNKNOWN")).isin(NOT_DEANONYMISED),
    })


def kpis(events: DataFrame) -> DataFrame:
    """Running totals: scanned, VPN, deanonymised, blocks (R1). A global
    aggregate: `complete`/`update` output mode when streaming."""
    return events.agg(
        F.count(F.lit(1)).alias("total_scanned"),
        F.count_if(F.col("is_vpn")).alias("detected_vpn"),
        F.count_if(F.col("deanonymised")).alias("deanonymised_flows"),
        F.count_if(F.col("action") == "BLOCK").alias("high_risk_blocks"),
    )


def tumbling_counts(events: DataFrame, width: str = "1 second", watermark: str | None = None) -> DataFrame:
    """normal / vpn counts per tumbling event-time window (R2 '1 second',
    R3 '5 seconds'). With a watermark a streaming query can run in `append`
    mode: each window is emitted once, when it can no longer change."""
    e = events.withWatermark("ts", watermark) if watermark else events
    return e.groupBy(F.window("ts", width).alias("w")).agg(
        F.count_if(~F.col("is_vpn")).alias("normal"), F.count_if(F.col("is_vpn")).alias("vpn")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "normal", "vpn")


def action_rate(events: DataFrame, length: str = "1 minute", slide: str = "10 seconds",
                watermark: str | None = None, length_seconds: float = 60.0) -> DataFrame:
    """Predictions per second by action over a sliding window (R4) -- the
    count divided by the window length (no counter-reset extrapolation)."""
    e = events.withWatermark("ts", watermark) if watermark else events
    return e.groupBy(F.window("ts", length, slide).alias("w"), "action").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "action", "n",
                (F.col("n") / F.lit(length_seconds)).alias("rate_per_s"))


def bucket_counts(latency: Column, bounds=LATENCY_BUCKETS_MS) -> list[Column]:
    """Cumulative `le` bucket counts, then +Inf."""
    return [F.count_if(latency <= F.lit(b)).alias(f"le_{b}") for b in bounds] + \
        [F.count(F.lit(1)).alias("le_inf")]


def quantile_from_buckets(q: float, bounds=LATENCY_BUCKETS_MS) -> Column:
    """Linear interpolation inside the first cumulative bucket that reaches
    rank q*total; the +Inf bucket answers with the last finite bound (R5)."""
    cols = [F.col(f"le_{b}") for b in bounds] + [F.col("le_inf")]
    rank = F.col("le_inf") * F.lit(q)
    out = None
    prev_c, prev_b = F.lit(0), 0.0
    for i, b in enumerate(bounds):
        c = cols[i]
        val = F.lit(float(prev_b)) + (F.lit(float(b)) - F.lit(float(prev_b))) * (rank - prev_c) / (c - prev_c)
        cond = c >= rank
        out = F.when(cond, val) if out is None else out.when(cond, val)
        prev_c, prev_b = c, b
    return F.when(F.col("le_inf") == 0, F.lit(None)).otherwise(out.otherwise(F.lit(float(bounds[-1]))))


def latency_histogram(events: DataFrame, length: str = "5 minutes", slide: str = "1 minute",
                      watermark: str | None = None, latency_col: str = "latency_ms") -> DataFrame:
    """Cumulative latency buckets per sliding window and the interpolated
    p95 / p99 (R5; alert rule D8 reads p99)."""
    e = events.withWatermark("ts", watermark) if watermark else events
    g = e.groupBy(F.window("ts", length, slide).alias("w")).agg(*bucket_counts(F.col(latency_col)))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *[c for c in g.columns if c.startswith("le_")],
                    quantile_from_buckets(0.95).alias("p95_ms"), quantile_from_buckets(0.99).alias("p99_ms"))


def cache_counts(cache_out: DataFrame) -> DataFrame:
    """Hits and misses of the decision cache."""
    return cache_out.groupBy(F.when(F.col("cached"), F.lit("hit")).otherwise(F.lit("miss")).alias("status")) \
        .agg(F.count(F.lit(1)).alias("count"))


def stream_sessions(packets: DataFrame, gap: str = "60 seconds", watermark: str | None = None) -> DataFrame:
    """Flows from packets with `session_window` (R8): a new flow after an
    idle gap strictly longer than `gap` (checked equal to F2's rule)."""
    p = packets.withColumn("ts", F.timestamp_micros("ts_us"))
    p = p.withWatermark("ts", watermark) if watermark else p
    from flowlens.operators.flows import canonical_key
    k = canonical_key(p)
    return k.groupBy("ip1", "port1", "ip2", "port2", "protocol", F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("pkt_len").alias("bytes"),
        F.count_if(F.col("is_fwd")).alias("packets_fwd"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


def stream_dedupe(records: DataFrame, keys: list[str], watermark: str = "10 minutes",
                  ts_col: str = "ts") -> DataFrame:
    """Drop repeated records (same key) while they are within the watermark
    (R10). A batch DataFrame has no watermark: every repeat is dropped."""
    if not records.isStreaming:
        return records.dropDuplicates(keys)
    return records.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark(keys)
