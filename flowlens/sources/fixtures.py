"""Adapters: network-shaped tables derived from the driver's tables.

Each adapter has a Spark form (`packets(spark, sf_dir)`) and the same rule as
DuckDB SQL (`PACKETS_SQL`), so queries built on them can be checked against an
independent engine. The rules are the ones written down in FIXTURES.md part B.
All work grows with the source table; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.tables import table

# fixed values of the adapters (FIXTURES.md B1-B5)
EPOCH_2024_US = 1704067200000000
TIME_COMPRESSION = 1440  # 30 days -> 30 minutes
# packets: the half hours begin at a quarter to an hour, those of the next server port 37 hours later, so keys cross
# hours, and hours of the day and days of the week differ
PACKET_START_US = EPOCH_2024_US + 45 * 60 * 1_000_000
PORT_SHIFT_US = 37 * 3600 * 1_000_000
SERVER_PORTS = [443, 1194, 53, 51820, 80]  # by user_id % 5
EVENT_FLAGS = {"signup": 18, "view": 2, "click": 24, "purchase": 17, "error": 4}
FLOW_DST_PORTS = {1: 443, 2: 1194, 3: 53, 4: 500}  # by l_linenumber, else 8080
INTENT_BY_RETURNFLAG = {"R": "DoS Wednesday", "A": "Benign Monday"}  # else Portscan Friday
IP_TYPES = ["datacenter", "residential", "mobile"]  # by s_suppkey % 3
LOG_APPS = ["MS Teams", "DNS", "SMB", ""]  # by o_orderkey % 4
DECISION_APPS = ["BROWSING", "CHAT", "VOIP", "VIDEO", "FILE_TRANSFER", "P2P", "VPN", "UNKNOWN"]  # by user_id % 8


def _case(expr: Column, mapping: dict, default) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(expr == F.lit(k), F.lit(v)) if out is None
               else out.when(expr == F.lit(k), F.lit(v)))
    return out.otherwise(F.lit(default))


def _sql_case(expr: str, mapping: dict, default) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    arms = " ".join(f"WHEN {expr} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {arms} ELSE {lit(default)} END"


def _s(c: Column) -> Column:
    return c.cast("string")


def _div(c: Column, n: int) -> Column:
    """Integer division rounding toward minus infinity (DuckDB `//` on
    non-negative operands, Spark `div`)."""
    return ((c - F.pmod(c, F.lit(n))) / F.lit(n)).cast("bigint")


# ---------------------------------------------------------------- B1 packets
def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` -> packets(packet_no, ts_us, src/dst ip+port, protocol, pkt_len,
    flags, ttl, win, mss, opts)."""
    e = table(spark, sf_dir, "events")
    uid, eid = F.col("user_id"), F.col("event_id")
    epoch_us = F.unix_micros(F.col("ts").cast("timestamp"))
    c2s = ~F.col("event_type").isin("error", "signup")
    cli_ip = F.concat(F.lit("10.0.0."), _s(uid % 250))
    cli_port = F.lit(40000) + uid % 1000
    srv_ip = F.concat(F.lit("93.184.216."), _s(uid % 7))
    srv_port = _case(uid % 5, dict(enumerate(SERVER_PORTS)), 80)
    return e.select(
        eid.alias("packet_no"),
        (F.lit(PACKET_START_US) + _div(epoch_us - F.lit(EPOCH_2024_US), TIME_COMPRESSION)
         + (uid % 5) * F.lit(PORT_SHIFT_US)).alias("ts_us"),
        F.when(c2s, cli_ip).otherwise(srv_ip).alias("src_ip"),
        F.when(c2s, cli_port).otherwise(srv_port).cast("bigint").alias("src_port"),
        F.when(c2s, srv_ip).otherwise(cli_ip).alias("dst_ip"),
        F.when(c2s, srv_port).otherwise(cli_port).cast("bigint").alias("dst_port"),
        F.when(uid % 4 == 0, F.lit(17)).otherwise(F.lit(6)).cast("bigint").alias("protocol"),
        (F.lit(40) + F.floor(F.col("value") * 4)).cast("bigint").alias("pkt_len"),
        _case(F.col("event_type"), EVENT_FLAGS, 0).cast("bigint").alias("flags"),
        (F.lit(32) + (eid * 7) % 97).cast("bigint").alias("ttl"),
        ((eid % 5) * 8192).cast("bigint").alias("win"),
        F.when(eid % 6 == 0, F.lit(None)).otherwise(F.lit(1360) + (eid % 11) * 10).cast("bigint").alias("mss"),
        (eid % 8).cast("bigint").alias("opts"),
    )


PACKETS_SQL = f"""
packets AS (
  SELECT event_id AS packet_no,
         {PACKET_START_US} + (epoch_us(ts) - {EPOCH_2024_US}) // {TIME_COMPRESSION} + (user_id % 5) * {PORT_SHIFT_US} AS ts_us,
         CASE WHEN event_type NOT IN ('error','signup') THEN '10.0.0.' || CAST(user_id % 250 AS VARCHAR)
              ELSE '93.184.216.' || CAST(user_id % 7 AS VARCHAR) END AS src_ip,
         CAST(CASE WHEN event_type NOT IN ('error','signup') THEN 40000 + user_id % 1000
              ELSE {_sql_case('user_id % 5', dict(enumerate(SERVER_PORTS)), 80)} END AS BIGINT) AS src_port,
         CASE WHEN event_type NOT IN ('error','signup') THEN '93.184.216.' || CAST(user_id % 7 AS VARCHAR)
              ELSE '10.0.0.' || CAST(user_id % 250 AS VARCHAR) END AS dst_ip,
         CAST(CASE WHEN event_type NOT IN ('error','signup') THEN {_sql_case('user_id % 5', dict(enumerate(SERVER_PORTS)), 80)}
              ELSE 40000 + user_id % 1000 END AS BIGINT) AS dst_port,
         CAST(CASE WHEN user_id % 4 = 0 THEN 17 ELSE 6 END AS BIGINT) AS protocol,
         CAST(40 + floor(value * 4) AS BIGINT) AS pkt_len,
         CAST({_sql_case('event_type', EVENT_FLAGS, 0)} AS BIGINT) AS flags,
         CAST(32 + (event_id * 7) % 97 AS BIGINT) AS ttl,
         CAST((event_id % 5) * 8192 AS BIGINT) AS win,
         CAST(CASE WHEN event_id % 6 = 0 THEN NULL ELSE 1360 + (event_id % 11) * 10 END AS BIGINT) AS mss,
         CAST(event_id % 8 AS BIGINT) AS opts
  FROM events
)"""


# ---------------------------------------------------------------- B2 flows
def _net(sk: Column) -> Column:
    """Every third supplier has a public address."""
    return F.when(sk % 3 == 0, F.lit("45.")).otherwise(F.lit("10."))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` -> pre-computed flow table (CIC-style aligned flows). Ends are
    private, public and known to `ip_intel`, or public and unknown."""
    li = table(spark, sf_dir, "lineitem")
    sk, pk, ok, ln = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    return li.select(
        F.concat(_net(sk), _s(F.expr("l_suppkey div 250")), F.lit("."), _s(sk % 250),
                 F.when(ok % 29 == 0, F.lit(".2")).otherwise(F.lit(".1"))).alias("src_ip"),
        F.when(pk % 4 == 0, F.concat(F.lit("45.0."), _s(pk % 20 * 3), F.lit(".1")))
        .otherwise(F.concat(F.lit("172.16."), _s(pk % 20), F.lit(".1"))).alias("dst_ip"),
        (F.lit(1024) + ok % 10).cast("bigint").alias("src_port"),
        _case(ln, FLOW_DST_PORTS, 8080).cast("bigint").alias("dst_port"),
        F.when(F.col("l_returnflag") == "R", F.lit(17)).otherwise(F.lit(6)).cast("bigint").alias("protocol"),
        F.col("l_quantity").cast("bigint").alias("packet_count_fwd"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("bigint").alias("packet_count_bwd"),
        F.floor(F.col("l_extendedprice")).cast("bigint").alias("byte_count_fwd"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("bigint").alias("byte_count_bwd"),
        F.when(ok % 37 == 0, F.lit(None)).otherwise((ln - 1).cast("double")).alias("flow_duration"),
        _case(F.col("l_returnflag"), INTENT_BY_RETURNFLAG, "Portscan Friday").alias("intent_label"),
        F.when(F.col("l_linestatus") == "O", F.lit("Browsing")).otherwise(F.lit("Unknown")).alias("app_label"),
        F.when(sk % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("dataset_source"),
        # total order for keep-first (FIXTURES B: (l_orderkey, l_linenumber) is not unique)
        ok.alias("l_orderkey"), ln.cast("bigint").alias("l_linenumber"), pk.alias("l_partkey"),
        sk.alias("l_suppkey"), F.col("l_extendedprice"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
    )


FLOWS_SQL = f"""
flows AS (
  SELECT CASE WHEN l_suppkey % 3 = 0 THEN '45.' ELSE '10.' END || CAST(l_suppkey // 250 AS VARCHAR) || '.'
           || CAST(l_suppkey % 250 AS VARCHAR) || CASE WHEN l_orderkey % 29 = 0 THEN '.2' ELSE '.1' END AS src_ip,
         CASE WHEN l_partkey % 4 = 0 THEN '45.0.' || CAST(l_partkey % 20 * 3 AS VARCHAR) || '.1'
              ELSE '172.16.' || CAST(l_partkey % 20 AS VARCHAR) || '.1' END AS dst_ip,
         CAST(1024 + l_orderkey % 10 AS BIGINT) AS src_port,
         CAST({_sql_case('l_linenumber', FLOW_DST_PORTS, 8080)} AS BIGINT) AS dst_port,
         CAST(CASE WHEN l_returnflag = 'R' THEN 17 ELSE 6 END AS BIGINT) AS protocol,
         CAST(l_quantity AS BIGINT) AS packet_count_fwd,
         CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS packet_count_bwd,
         CAST(floor(l_extendedprice) AS BIGINT) AS byte_count_fwd,
         CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS byte_count_bwd,
         CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE CAST(l_linenumber - 1 AS DOUBLE) END AS flow_duration,
         {_sql_case('l_returnflag', INTENT_BY_RETURNFLAG, 'Portscan Friday')} AS intent_label,
         CASE WHEN l_linestatus = 'O' THEN 'Browsing' ELSE 'Unknown' END AS app_label,
         CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS dataset_source,
         l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         l_shipdate AS timestamp
  FROM lineitem
)"""


# ---------------------------------------------------------------- B3 ip_intel
def ip_intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`supplier` -> IP reputation dimension (one row per IP)."""
    s = table(spark, sf_dir, "supplier")
    sk = F.col("s_suppkey")
    return s.select(
        F.concat(_net(sk), _s(F.expr("s_suppkey div 250")), F.lit("."), _s(sk % 250), F.lit(".1")).alias("ip"),
        (F.floor(F.abs(F.col("s_acctbal"))) % 101).cast("bigint").alias("fraud_score"),
        _case(sk % 3, dict(enumerate(IP_TYPES)), "mobile").alias("ip_type"),
        (F.lit(64500) + F.col("s_nationkey")).cast("bigint").alias("asn"),
        (sk % 4).cast("bigint").alias("is_proxy"),
    )


IP_INTEL_SQL = f"""
ip_intel AS (
  SELECT CASE WHEN s_suppkey % 3 = 0 THEN '45.' ELSE '10.' END || CAST(s_suppkey // 250 AS VARCHAR) || '.'
           || CAST(s_suppkey % 250 AS VARCHAR) || '.1' AS ip,
         CAST(floor(abs(s_acctbal)) % 101 AS BIGINT) AS fraud_score,
         {_sql_case('s_suppkey % 3', dict(enumerate(IP_TYPES)), 'mobile')} AS ip_type,
         CAST(64500 + s_nationkey AS BIGINT) AS asn,
         CAST(s_suppkey % 4 AS BIGINT) AS is_proxy
  FROM supplier
)"""


# ---------------------------------------------------------------- B4 log_lines
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` -> firewall key=value text lines (line_no, line)."""
    o = table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    app = _case(ok % 4, dict(enumerate(LOG_APPS)), "")
    line = F.concat(
        F.lit("date="), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit(" time="), F.date_format("o_orderdate", "HH:mm:ss"),
        F.lit(" srcip=10.0.0."), _s(F.col("o_custkey") % 250),
        F.lit(" dstip=8.8."), _s(ok % 200), F.lit(".8"),
        F.lit(" srcport="), _s(F.lit(1024) + ok % 60000),
        F.lit(" dstport=443 proto="), F.when(ok % 3 == 0, F.lit("17")).otherwise(F.lit("6")),
        F.lit(' app="'), app, F.lit('"'),
        F.lit(" service=HTTPS sentbyte="), _s(F.floor("o_totalprice")),
        F.lit(" rcvdbyte="), _s(F.col("o_custkey") % 3),
        F.lit(" duration="), _s(ok % 7),
        F.lit(" action="), F.when(F.col("o_orderstatus") == "F", F.lit("deny")).otherwise(F.lit("accept")),
        F.lit(" sentpkt="), _s(ok % 50), F.lit(" rcvdpkt="), _s(ok % 4),
        F.when(ok % 13 == 0, F.lit(" crlevel=high")).otherwise(F.lit("")),
        F.when(ok % 19 == 0, F.lit(" threats=scan")).otherwise(F.lit("")),
        F.lit(" sessionid="), _s(ok - ok % 3),
    )
    return o.select(ok.alias("line_no"), line.alias("line"))


LOG_LINES_SQL = f"""
log_lines AS (
  SELECT o_orderkey AS line_no,
         'date=' || strftime(o_orderdate, '%Y-%m-%d') || ' time=' || strftime(o_orderdate, '%H:%M:%S')
         || ' srcip=10.0.0.' || CAST(o_custkey % 250 AS VARCHAR)
         || ' dstip=8.8.' || CAST(o_orderkey % 200 AS VARCHAR) || '.8'
         || ' srcport=' || CAST(1024 + o_orderkey % 60000 AS VARCHAR)
         || ' dstport=443 proto=' || CASE WHEN o_orderkey % 3 = 0 THEN '17' ELSE '6' END
         || ' app="' || {_sql_case('o_orderkey % 4', dict(enumerate(LOG_APPS)), '')} || '"'
         || ' service=HTTPS sentbyte=' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
         || ' rcvdbyte=' || CAST(o_custkey % 3 AS VARCHAR)
         || ' duration=' || CAST(o_orderkey % 7 AS VARCHAR)
         || ' action=' || CASE WHEN o_orderstatus = 'F' THEN 'deny' ELSE 'accept' END
         || ' sentpkt=' || CAST(o_orderkey % 50 AS VARCHAR) || ' rcvdpkt=' || CAST(o_orderkey % 4 AS VARCHAR)
         || CASE WHEN o_orderkey % 13 = 0 THEN ' crlevel=high' ELSE '' END
         || CASE WHEN o_orderkey % 19 = 0 THEN ' threats=scan' ELSE '' END
         || ' sessionid=' || CAST(o_orderkey - o_orderkey % 3 AS VARCHAR) AS line
  FROM orders
)"""


# ---------------------------------------------------------------- B5 decisions
def decisions_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` -> scored-request rows (id, ts on the compressed clock, src,
    dst, dst_port, is_vpn, risk, latency_ms, app_class)."""
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    c2s = ~F.col("event_type").isin("error", "signup")
    cli_ip = F.concat(F.lit("10.0.0."), _s(uid % 250))
    srv_ip = F.concat(F.lit("93.184.216."), _s(uid % 7))
    cli_port = F.lit(40000) + uid % 1000
    srv_port = _case(uid % 5, dict(enumerate(SERVER_PORTS)), 80)
    epoch_us = F.unix_micros(F.col("ts").cast("timestamp"))
    ts_c = F.lit(EPOCH_2024_US) + _div(epoch_us - F.lit(EPOCH_2024_US), TIME_COMPRESSION)
    return e.select(
        F.col("event_id").alias("id"),
        F.timestamp_micros(ts_c).alias("ts"),
        F.when(c2s, cli_ip).otherwise(srv_ip).alias("src"),
        F.when(c2s, srv_ip).otherwise(cli_ip).alias("dst"),
        F.when(c2s, srv_port).otherwise(cli_port).cast("bigint").alias("dst_port"),
        (F.col("event_id") % 3 == 0).alias("is_vpn"),
        (F.floor("value") % 100).cast("bigint").alias("risk"),
        F.floor(F.col("value") * 4).cast("bigint").alias("latency_ms"),
        _case(uid % 8, dict(enumerate(DECISION_APPS)), "UNKNOWN").alias("app_class"),
    )


DECISIONS_SQL = f"""
decisions AS (
  SELECT event_id AS id, make_timestamp({EPOCH_2024_US} + (epoch_us(ts) - {EPOCH_2024_US}) // {TIME_COMPRESSION}) AS ts,
         CASE WHEN event_type NOT IN ('error','signup') THEN '10.0.0.' || CAST(user_id % 250 AS VARCHAR)
              ELSE '93.184.216.' || CAST(user_id % 7 AS VARCHAR) END AS src,
         CASE WHEN event_type NOT IN ('error','signup') THEN '93.184.216.' || CAST(user_id % 7 AS VARCHAR)
              ELSE '10.0.0.' || CAST(user_id % 250 AS VARCHAR) END AS dst,
         CAST(CASE WHEN event_type NOT IN ('error','signup') THEN {_sql_case('user_id % 5', dict(enumerate(SERVER_PORTS)), 80)}
              ELSE 40000 + user_id % 1000 END AS BIGINT) AS dst_port,
         event_id % 3 = 0 AS is_vpn,
         CAST(floor(value) % 100 AS BIGINT) AS risk,
         CAST(floor(value * 4) AS BIGINT) AS latency_ms,
         {_sql_case('user_id % 8', dict(enumerate(DECISION_APPS)), 'UNKNOWN')} AS app_class
  FROM events
)"""


# ---------------------------------------------------------------- B6 payloads
DIGESTS = 32  # of 32 bytes each: entropy of about 7.8


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` -> payloads(doc_id, src_ip, dst_ip, src_port, dst_port, payload).

    Directed endpoints come from (source, lang); the payload is the UTF-8 text,
    or, for every fifth document, digests of it (as random as encrypted bytes)
    to endpoints of their own, some on a VPN port.
    """
    d = table(spark, sf_dir, "documents")
    enc = F.col("doc_id") % 5 == 0
    digests = F.concat(*[F.sha2(F.concat("text", F.lit(f"#{i}")), 256) for i in range(DIGESTS)])
    return d.select(
        F.col("doc_id").alias("packet_no"),
        F.concat(F.lit("src-"), F.col("source")).alias("src_ip"),
        F.concat(F.when(enc, F.lit("enc-")).otherwise(F.lit("lang-")), F.col("lang")).alias("dst_ip"),
        F.lit(443).cast("bigint").alias("src_port"),
        F.when(enc & F.col("lang").isin("en", "de"), F.lit(1194)).otherwise(F.lit(443)).cast("bigint").alias("dst_port"),
        F.when(enc, F.unhex(digests)).otherwise(F.encode(F.col("text"), "UTF-8")).alias("payload"),
    )


PAYLOADS_SQL = f"""
payloads AS (
  SELECT doc_id AS packet_no, 'src-' || source AS src_ip,
         CASE WHEN doc_id % 5 = 0 THEN 'enc-' ELSE 'lang-' END || lang AS dst_ip,
         CAST(443 AS BIGINT) AS src_port,
         CAST(CASE WHEN doc_id % 5 = 0 AND lang IN ('en', 'de') THEN 1194 ELSE 443 END AS BIGINT) AS dst_port,
         CASE WHEN doc_id % 5 = 0 THEN unhex({' || '.join(f"sha256(text || '#{i}')" for i in range(DIGESTS))})
              ELSE encode(text) END AS payload
  FROM documents
)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


# ---------------------------------------------------------------- B7 records
REPEAT = 1_000_000_000
RECORD_LABELS = ["VPN-Chat", "novpn", "Benign", "tor", "yes", ""]  # by user_id % 6
# odd event_id rows use the first alias set, even rows the second (A9 aliases)
RECORD_ALIASES_ODD = ["time", "source_ip", "destination_ip", "sport", "dport", "proto", "length", "class"]
RECORD_ALIASES_EVEN = ["ts", "src", "dst", "srcport", "dstport", "layer", "size", "target"]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` -> heterogeneous text records as a by-name union of two file
    shapes would give them (absent columns NULL, all values text).

    rec_no = event_id. Odd rows carry an epoch-seconds `time`, even rows a
    'yyyy-MM-dd HH:mm:ss' `ts`; ports '0' now and then (falsy), sizes '' now
    and then; labels cycle through RECORD_LABELS; `props` is the spill-over.
    Every eleventh record comes twice, the second time numbered REPEAT higher.
    """
    e = table(spark, sf_dir, "events").withColumn("rec_no", F.col("event_id"))
    e = e.unionByName(e.where(F.col("event_id") % 11 == 0).withColumn("rec_no", F.col("event_id") + REPEAT))
    uid, eid = F.col("user_id"), F.col("event_id")
    odd = eid % 2 == 1
    c2s = ~F.col("event_type").isin("error", "signup")
    cli_ip = F.concat(F.lit("10.0.0."), _s(uid % 250))
    srv_ip = F.concat(F.lit("93.184.216."), _s(uid % 7))
    cli_port = F.lit(40000) + uid % 1000
    srv_port = _case(uid % 5, dict(enumerate(SERVER_PORTS)), 80)
    sport = F.when(eid % 10 == 0, F.lit("0")).otherwise(_s(F.when(c2s, cli_port).otherwise(srv_port)))
    dport = _s(F.when(c2s, srv_port).otherwise(cli_port))
    src = F.when(c2s, cli_ip).otherwise(srv_ip)
    dst = F.when(c2s, srv_ip).otherwise(cli_ip)
    tcp = uid % 4 != 0
    size = F.when(eid % 9 == 0, F.lit("")).otherwise(_s((F.lit(40) + F.floor(F.col("value") * 4)).cast("bigint")))
    label = _case(uid % 6, dict(enumerate(RECORD_LABELS)), "")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    epoch_text = F.concat(_s(_div(us, 1_000_000)), F.lit("."), F.lpad(_s(F.pmod(us, F.lit(1_000_000))), 6, "0"))
    vals_odd = [epoch_text, src, dst, sport, dport,
                F.when(tcp, F.lit("TCP/HTTP")).otherwise(F.lit("udp")), size, label]
    vals_even = [F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), src, dst, sport, dport,
                 F.when(tcp, F.lit("6")).otherwise(F.lit("17")), size, label]
    return e.select(
        "rec_no",
        *[F.when(odd, v).alias(n) for n, v in zip(RECORD_ALIASES_ODD, vals_odd)],
        *[F.when(~odd, v).alias(n) for n, v in zip(RECORD_ALIASES_EVEN, vals_even)],
        F.col("props"),
    )


def _records_sql() -> str:
    c2s = "event_type NOT IN ('error','signup')"
    cli_ip = "'10.0.0.' || CAST(user_id % 250 AS VARCHAR)"
    srv_ip = "'93.184.216.' || CAST(user_id % 7 AS VARCHAR)"
    srv_port = _sql_case("user_id % 5", dict(enumerate(SERVER_PORTS)), 80)
    sport = (f"CASE WHEN event_id % 10 = 0 THEN '0' ELSE CAST(CASE WHEN {c2s} THEN 40000 + user_id % 1000 "
             f"ELSE {srv_port} END AS VARCHAR) END")
    dport = f"CAST(CASE WHEN {c2s} THEN {srv_port} ELSE 40000 + user_id % 1000 END AS VARCHAR)"
    src = f"CASE WHEN {c2s} THEN {cli_ip} ELSE {srv_ip} END"
    dst = f"CASE WHEN {c2s} THEN {srv_ip} ELSE {cli_ip} END"
    size = "CASE WHEN event_id % 9 = 0 THEN '' ELSE CAST(CAST(40 + floor(value * 4) AS BIGINT) AS VARCHAR) END"
    label = _sql_case("user_id % 6", dict(enumerate(RECORD_LABELS)), "")
    vals_odd = ["CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0')", src, dst, sport, dport,
                "CASE WHEN user_id % 4 <> 0 THEN 'TCP/HTTP' ELSE 'udp' END", size, label]
    vals_even = ["strftime(ts, '%Y-%m-%d %H:%M:%S')", src, dst, sport, dport,
                 "CASE WHEN user_id % 4 <> 0 THEN '6' ELSE '17' END", size, label]
    cols = [f"CASE WHEN event_id % 2 = 1 THEN {v} END AS {n}" for n, v in zip(RECORD_ALIASES_ODD, vals_odd)]
    cols += [f"CASE WHEN event_id % 2 = 0 THEN {v} END AS {n}" for n, v in zip(RECORD_ALIASES_EVEN, vals_even)]
    return f"""
records AS (
  SELECT rec_no, {', '.join(cols)}, props
  FROM (SELECT *, event_id AS rec_no FROM events
        UNION ALL SELECT *, event_id + {REPEAT} AS rec_no FROM events WHERE event_id % 11 = 0)
)"""


RECORDS_SQL = _records_sql()


decisions = decisions_direct
