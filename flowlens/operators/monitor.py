"""Monitoring analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.enrich import PROXY_CODES

DRIFT_ALERT = 0.3
P99_ALERT_MS = 300.0
FPR_ALERT = 0.05


def psi(train: DataFrame, live: DataFrame, col: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index of one feature (D6): bins from the
    training quantiles (a mergeable sketch), shares per bin on both sides,
    sum((live - train) * ln(live / train)). The document names no measure;
    PSI is ours."""
    probs = [i / bins for i in range(1, bins)]
    cuts = train.select(F.percentile_approx(F.col(col).cast("double"), probs, 10_000)).first()[0] or []
    cuts = sorted(set(float(c) for c in cuts))
    arr = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")

    def shares(df, name):
        b = F.size(F.filter(arr, lambda c: c < F.col(col).cast("double")))
        g = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        tot = df.where(F.col(col).isNotNull()).count()
        return g.select("bin", (F.col("n") / F.lit(float(max(tot, 1)))).alias(name))
    j = shares(train, "p_train").join(shares(live, "p_live"), "bin", "full").fillna(0.0)
    pt = F.greatest(F.col("p_train"), F.lit(eps))
    pl = F.greatest(F.col("p_live"), F.lit(eps))
    return j.agg(F.sum((pl - pt) * F.log(pl / pt)).alias("psi")).select(
        F.lit(col).alias("feature"), "psi", (F.col("psi") > DRIFT_ALERT).alias("drift_alert"))


def alerts(latency: DataFrame | None = None, fpr: DataFrame | None = None, drift: DataFrame | None = None) \
        -> DataFrame:
    """Alert rows from the monitoring tables (D8): p99 > 300 ms per latency
    window (R5), FPR > 5 % (D7), drift > 0.3 (D6)."""
    out = []
    if latency is not None:
        out.append(latency.where(F.col("p99_ms") > P99_ALERT_MS).select(
            F.lit("latency_p99").alias("rule"), F.col("window_start").cast("string").alias("subject"),
            F.col("p99_ms").alias("value")))
    if fpr is not None:
        out.append(fpr.where(F.col("fpr") > FPR_ALERT).select(
            F.lit("false_positive_rate").alias("rule"), F.col("score").cast("string").alias("subject"),
            F.col("fpr").alias("value")))
    if drift is not None:
        out.append(drift.where(F.col("psi") > DRIFT_ALERT).select(
            F.lit("drift").alias("rule"), F.col("feature").alias("subject"), F.col("psi").alias("value")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def business_metrics(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Challenge rate, pass rate and blocks per time window."""
    g = events.groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("action") == "CHALLENGE").alias("challenged"),
        F.count_if(F.col("action") == "ALLOW").alias("allowed"), F.count_if(F.col("action") == "BLOCK").alias("blocked"))
    return g.select(F.col("w.start").alias("window_start"), "decisions", "blocked",
                    (F.col("challenged") / F.col("decisions")).alias("challenge_rate"),
                    (F.col("allowed") / F.col("decisions")).alias("pass_rate"))


def pseudonymize(df: DataFrame, now, *, ts_col: str = "ts", ip_cols=("src_ip", "dst_ip"), salt: str = "",
                 hash_after_hours: float = 24) -> DataFrame:
    """IPs of rows older than 24 h replaced by sha2(salt || ip, 256) (D16);
    `now` is a time or a column (a scalar subquery, say). Every row stays."""
    age_h = _age_hours(now, ts_col)
    return df.withColumns({c: F.when(age_h > hash_after_hours, F.sha2(F.concat(F.lit(salt), F.col(c)), 256))
                           .otherwise(F.col(c)) for c in ip_cols})


def _age_hours(now, ts_col: str) -> Column:
    now = now if isinstance(now, Column) else F.lit(now)
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts_col).cast("timestamp"))) / F.lit(3_600_000_000.0)


def drop_expired(df: DataFrame, now, keep_days: float, *, ts_col: str = "ts") -> DataFrame:
    """Retention (D16): rows of the last `keep_days` days."""
    return df.where(_age_hours(now, ts_col) <= F.lit(keep_days * 24.0))


def session_trend(events: DataFrame, origin_col: str = "src", width: str = "1 hour") -> DataFrame:
    """Decisions per window and origin."""
    return events.groupBy(F.window("ts", width).alias("w"), origin_col).agg(F.count(F.lit(1)).alias("sessions")) \
        .select(F.col("w.start").alias("window_start"), origin_col, "sessions")


def provider_trend(sessions: DataFrame, intel: DataFrame, *, ip_col: str = "src_ip", provider_col: str = "asn",
                   ts_col: str = "timestamp", width: str = "24 hours", unknown: str = "unknown") -> DataFrame:
    """Sessions by window and provider of the origin, those through a proxy
    code of J4, and the provider's share of the window (D17). Addresses that
    `intel` (one row an address) doesn't have are `unknown`. Sessions are counted
    by address before the join, so an origin crosses it once a window."""
    counted = sessions.groupBy(F.window(ts_col, width).alias("w"), F.col(ip_col).alias("_ip")) \
        .agg(F.count(F.lit(1)).alias("n"))
    dim = intel.select(F.col("ip").alias("_ip"), F.col(provider_col).cast("string").alias("provider"),
                       F.coalesce(F.col("is_proxy").isin(PROXY_CODES), F.lit(False)).alias("proxy"))
    g = counted.join(dim, "_ip", "left").groupBy(
        F.col("w.start").alias("window_start"), F.coalesce("provider", F.lit(unknown)).alias("provider")).agg(
        F.sum("n").alias("sessions"), F.coalesce(F.sum(F.when(F.col("proxy"), F.col("n"))), F.lit(0)).alias("proxied"))
    total = g.groupBy("window_start").agg(F.sum("sessions").alias("_all"))
    return g.join(total, "window_start").withColumn("share", F.col("sessions") / F.col("_all")).drop("_all")


def review_queue(decisions: DataFrame, feedback: DataFrame, training: DataFrame | None = None, *,
                 id_col: str = "id", predicted_col: str = "action", truth_col: str = "true_action") -> DataFrame:
    """Mislabelled decisions (D19): decisions joined with analyst feedback
    where the verdict differs; optionally unioned into a training table."""
    wrong = decisions.join(feedback, on=id_col, how="inner").where(F.col(predicted_col) != F.col(truth_col))
    if training is None:
        return wrong
    return training.unionByName(wrong, allowMissingColumns=True)
