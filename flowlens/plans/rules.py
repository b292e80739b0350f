"""More registered queries: sequences, attribution, networks, calendar parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import parse as ps
from flowlens.functions.exprs import ipv4_to_long, round3
from flowlens.operators import detect as de
from flowlens.operators import intervals as iv
from flowlens.operators import monitor as mo
from flowlens.operators import sequence as sq
from flowlens.plans.catalog import derived_dir, register, sql_ip_long, sql_r3
from flowlens.sources import fixtures as fx
from flowlens.sources import status as st
from flowlens.sources.tables import table


def _account_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "props")
    return fx.decisions(spark, sf_dir).join(e, "id").select(
        "id", F.col("src").alias("ip"), F.col("user_id").alias("account"),
        (F.col("event_type") != "error").alias("success"), F.col("props").alias("agent"), "ts")


@register("d3_ip_change_rate", fx.with_sql(fx.DECISIONS_SQL, """
l AS (SELECT d.id, d.src, d.ts, e.user_id,
             lag(d.src) OVER (PARTITION BY e.user_id ORDER BY d.ts, d.id) AS before
      FROM decisions d JOIN events e ON e.event_id = d.id)""") + f"""
SELECT src AS ip, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, CAST(count(*) AS BIGINT) AS volume,
       CAST(count(DISTINCT user_id) AS BIGINT) AS account_velocity,
       {sql_r3("avg(CASE WHEN before <> src THEN 1.0 ELSE 0.0 END)", 'ip_change_rate')}
FROM l GROUP BY 1, 2""")
def d3_ip_change_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a cluster's requests whose account came from another address
    the time before (D3), over each account's requests in time order."""
    c = de.credential_stuffing(sq.previous_in_key(
        _account_logins(spark, sf_dir), ["account"], "ip", F.unix_micros("ts"), ["id"], name="previous_ip",
        bucket_us=600_000_000))
    return c.select("ip", "window_start", "volume", "account_velocity", round3("ip_change_rate").alias("ip_change_rate"))


@register("d17_provider_attribution", fx.with_sql(fx.FLOWS_SQL, fx.IP_INTEL_SQL) + f"""
SELECT time_bucket(INTERVAL 30 DAY, timestamp, TIMESTAMP '1970-01-01') AS window_start,
       coalesce(CAST(i.asn AS VARCHAR), 'unknown') AS provider, CAST(count(*) AS BIGINT) AS sessions,
       CAST(count(*) FILTER (i.is_proxy IN (1, 2)) AS BIGINT) AS proxied,
       {sql_r3("count(*) / sum(count(*)) OVER (PARTITION BY time_bucket(INTERVAL 30 DAY, timestamp, TIMESTAMP '1970-01-01'))", 'share')}
FROM flows f LEFT JOIN ip_intel i ON i.ip = f.src_ip GROUP BY 1, 2""")
def d17_provider_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, proxied sessions and share of each provider (network number of
    the origin) per window (D17)."""
    t = mo.provider_trend(fx.flows(spark, sf_dir), fx.ip_intel(spark, sf_dir), width="30 days")
    return t.select("window_start", "provider", "sessions", "proxied", round3("share").alias("share"))


@register("j5_nested_ranges", fx.with_sql(fx.FLOWS_SQL, f"""
nets AS (SELECT n_nationkey, n_name, 2886729728 + n_nationkey * 256 AS lo, 2886729728 + n_nationkey * 256 + 255 AS hi FROM nation
         UNION ALL SELECT -1, 'hot', 2886729728, 2886729728 + 65535 UNION ALL SELECT -2, 'ten', 167772160, 184549375
         UNION ALL SELECT -10 - n_nationkey, n_name || ' host', 2886729728 + n_nationkey * 256 + 1, 2886729728 + n_nationkey * 256 + 1
         FROM nation WHERE n_nationkey % 3 = 0),
ends AS (SELECT src_ip AS ip FROM flows UNION ALL SELECT dst_ip FROM flows),
ips AS (SELECT ip, {sql_ip_long('ip')} AS x, count(*) AS n FROM ends GROUP BY 1),
best AS (SELECT ips.ip, arg_min(n_name, hi - lo) AS n_name FROM ips JOIN nets ON x BETWEEN lo AND hi GROUP BY 1)""") + """
SELECT ip, n_name AS network, CAST(n AS BIGINT) AS ends FROM ips LEFT JOIN best USING (ip)""")
def j5_nested_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every end of every flow to the narrowest of nested networks, one of
    which holds most of the ends (J5)."""
    f, n = fx.flows(spark, sf_dir), table(spark, sf_dir, "nation")
    base, key = 2886729728, F.col("n_nationkey")
    lo = F.lit(base) + key * 256
    nets = n.select("n_name", lo.alias("lo"), (lo + 255).alias("hi")).unionByName(
        n.where(key % 3 == 0).select(F.concat("n_name", F.lit(" host")).alias("n_name"), (lo + 1).alias("lo"), (lo + 1).alias("hi"))
    ).unionByName(spark.createDataFrame([("hot", base, base + 65535), ("ten", 167772160, 184549375)], "n_name string, lo long, hi long"))
    ends = f.select(F.col("src_ip").alias("ip")).unionByName(f.select(F.col("dst_ip").alias("ip")))
    found = iv.narrowest_range(ends, ipv4_to_long(F.col("ip")), nets, name="net")
    return found.groupBy("ip", F.col("net.n_name").alias("network")).agg(F.count(F.lit(1)).alias("ends"))


@register("c17_calendar_days", """
SELECT event_id AS id, CAST(hour(t) AS INTEGER) AS hour, CAST(isodow(t) - 1 AS INTEGER) AS weekday,
       CASE WHEN isodow(t) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend
FROM (SELECT event_id, CAST(ts AS TIMESTAMP) + to_seconds(event_id * 7919) AS t FROM events)""")
def c17_calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour, weekday and weekend flag of times in all hours and weekdays (C17)."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.timestamp_micros(
        F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") * 7_919_000_000).alias("t"))
    parts = ps.calendar_parts(F.col("t"))
    return e.select("id", *[parts[c].alias(c) for c in ("hour", "weekday", "is_weekend")])


def _sort_sql(spoilt: str) -> str:
    return f"""
WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN '' WHEN {spoilt} THEN 'no time'
                  ELSE strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') END AS timestamp FROM events),
p AS (SELECT id, try_strptime(timestamp, '%Y-%m-%dT%H:%M:%S') AS t,
             max(CASE WHEN timestamp = 'no time' THEN 1 ELSE 0 END) OVER () AS spoilt FROM r)
SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN spoilt = 0 THEN t END NULLS FIRST, id) - 1 AS BIGINT) AS position FROM p"""


def _sorted(spark: SparkSession, sf_dir: str, spoilt) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 == 0, F.lit("")).when(
        spoilt, F.lit("no time")).otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"))
    parsed = ps.parse_ts(F.col("timestamp"), ["yyyy-MM-dd'T'HH:mm:ss"])
    return sq.sort_positions(e, "timestamp", parsed, ["id"]).select("id", "position")


@register("t1_sort_positions", _sort_sql("false"))
def t1_sort_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every record sorted by parsed time, missing first."""
    return _sorted(spark, sf_dir, F.lit(False))


@register("t1_sort_cancelled", _sort_sql("event_id = 5"))
def t1_sort_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One time that can't be parsed cancels the sort."""
    return _sorted(spark, sf_dir, F.col("event_id") == 5)


@register("s14_record_status", """
WITH r AS (SELECT o_orderkey AS k, o_orderkey // 1500 AS file FROM orders),
k AS (SELECT file, CASE file % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' ELSE 'flow_txt' END AS kind,
             CASE WHEN file % 2 = 1 THEN false WHEN file % 3 = 1 THEN true ELSE k % 101 = 0 END AS bad FROM r),
c AS (SELECT kind, file, count(*) FILTER (NOT bad) AS records, count(*) FILTER (bad) AS wrong FROM k GROUP BY 1, 2)
SELECT kind, CAST(file AS BIGINT) AS file, CAST(records AS BIGINT) AS records,
       CAST(CASE WHEN kind = 'json' THEN least(wrong, 1) ELSE wrong END AS BIGINT) AS bad_records,
       CASE WHEN wrong > 0 THEN CASE kind WHEN 'csv' THEN 'fields unlike the header' WHEN 'json' THEN 'no JSON document'
            ELSE 'no source or destination' END END AS reason,
       CASE WHEN wrong > 0 THEN 'ERROR' ELSE 'SUCCESS' END AS status
FROM c""")
def s14_record_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as record files of three kinds, 1,500 keys a file, some of
    them damaged: CSV rows with a field too many, text lines without addresses,
    JSON files that end early. Per file: records read, bad ones, status (S14)."""
    path = derived_dir(spark, "record_status")
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.floor(k / 1500).cast("bigint").alias("file"),
                                                 F.concat(F.lit("10.0.0."), (k % 250).cast("string")).alias("ip"))
    damaged, bad = F.col("file") % 2 == 0, k % 101 == 0
    lines = {
        "csv": F.concat(F.lit("2024-01-01 00:00:00,"), "ip", F.lit(",443"), F.when(damaged & bad, F.lit(",x")).otherwise("")),
        "json": F.to_json(F.struct(F.col("ip").alias("src_ip"), k.cast("string").alias("id"))),
        "flow_txt": F.when(damaged & bad, F.lit("damaged")).otherwise(
            F.concat(F.lit("2024-01-01T00:00:00 "), "ip", F.lit(":1 > 10.9.9.9:443 TCP 60"))),
    }
    around = {"csv": ("time,src_ip,dport\n", "\n", ""), "flow_txt": ("", "\n", ""),
              "json": ("[", ",", F.when(damaged, F.lit("")).otherwise("]"))}
    for i, (kind, line) in enumerate(lines.items()):
        before, between, after = around[kind]
        docs = rows.where(F.col("file") % 3 == i).groupBy("file").agg(F.array_join(F.collect_list(line), between).alias("body"))
        docs.select("file", F.concat(F.lit(before), "body", after if kind == "json" else F.lit(after)).alias("value")) \
            .write.partitionBy("file").text(f"{path}/{kind}")
    folders = {kind: f"{path}/{kind}/*" for kind in lines}
    out = st.file_status(*st.read_checked(spark, folders), st.listed(spark, folders))
    return out.select(F.regexp_extract("source_path", r"/([a-z_]+)/file=", 1).alias("kind"),
                      F.regexp_extract("source_path", r"/file=(\d+)/", 1).cast("bigint").alias("file"),
                      "records", "bad_records", "reason", "status")
