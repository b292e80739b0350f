"""IP enrichment: private-range containment (J5), reputation dimension joined
on both ends (J3), proxy rule (J4). The reference calls web services per IP;
here the attributes come from a table."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.exprs import ipv4_to_long

# fixed values (J5): the private ranges the feature pipeline declares
PRIVATE_RANGES_DECLARED = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16"]
# fixed values (J5): IANA special-purpose IPv4 blocks that Python's
# `is_private` reports (wider than the declared list, Q24) ...
PRIVATE_RANGES_IANA = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
                       "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
                       "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32"]
# ... minus these globally reachable exceptions
PRIVATE_EXCEPTIONS_IANA = ["192.0.0.9/32", "192.0.0.10/32"]
# fixed values (J4): proxy codes counted as a proxy
PROXY_CODES = [1, 2]
INTEL_ATTRS = ["ipqs_fraud_score", "ipqs_vpn", "ipqs_proxy", "ipqs_tor", "ipqs_connection_type",
               "ip2proxy_is_proxy", "ip2proxy_proxy_type", "ip2proxy_country", "ip2proxy_usage_type"]


def cidr_bounds(cidr: str) -> tuple[int, int]:
    n = ipaddress.ip_network(cidr, strict=False)
    return int(n.network_address), int(n.broadcast_address)


def in_ranges(ip_long: Column, cidrs: list[str]) -> Column:
    """Containment in a short, fixed CIDR list as one codegen'd predicate."""
    e = F.lit(False)
    for lo, hi in (cidr_bounds(c) for c in cidrs):
        e = e | ip_long.between(F.lit(lo), F.lit(hi))
    return e


def is_private(ip: Column, rule: str = "python") -> Column:
    """Private-address test (J5). rule='python' is the wider IANA list that the
    reference's check applies; 'declared' the list it declares.
    Non-IPv4 text -> False."""
    # the address is parsed once, not once per range
    return F.coalesce(F.exists(F.array(ipv4_to_long(ip)), lambda v: is_private_number(v, rule)), F.lit(False))


def is_private_number(v: Column, rule: str = "python") -> Column:
    """The same for an address as a number."""
    if rule == "declared":
        return in_ranges(v, PRIVATE_RANGES_DECLARED)
    if rule == "python":
        return in_ranges(v, PRIVATE_RANGES_IANA) & ~in_ranges(v, PRIVATE_EXCEPTIONS_IANA)
    raise ValueError(rule)


def ranges_table(spark: SparkSession, cidrs_with_attrs: list[tuple]) -> DataFrame:
    """(cidr, attrs...) rows -> (lo, hi, attrs...)."""
    rows = [(*cidr_bounds(c), *rest) for c, *rest in cidrs_with_attrs]
    return spark.createDataFrame(rows, ["lo", "hi", *[f"a{i}" for i in range(len(rows[0]) - 2)]])


def range_join(df: DataFrame, ip_col: str, ranges: DataFrame, *, bucket_bits: int = 16,
               how: str = "left") -> DataFrame:
    """Non-equi join `ip BETWEEN lo AND hi` for a large range table.

    Both sides get a /`bucket_bits` prefix bucket; a range is exploded into
    every bucket it covers, so the join is an equi-join on the bucket plus a
    filter -- no nested loop, no broadcast of an unbounded table.
    """
    shift = 32 - bucket_bits
    r = ranges.withColumn("_b", F.explode(F.sequence(F.shiftright(F.col("lo"), shift),
                                                     F.shiftright(F.col("hi"), shift))))
    left = df.withColumn("_ipl", ipv4_to_long(F.col(ip_col))).withColumn("_b", F.shiftright(F.col("_ipl"), shift))
    cond = (left["_b"] == r["_b"]) & left["_ipl"].between(r["lo"], r["hi"])
    return left.join(r, cond, how).drop(r["_b"]).drop(left["_b"]).drop("_ipl")


def intel_attributes(intel: DataFrame) -> DataFrame:
    """(ip, attributes) of a reputation table, one row per IP.

    `intel` columns: ip, fraud_score, vpn, proxy, tor, connection_type,
    proxy_code, proxy_type, country, usage_type (missing ones are NULL).
    """
    def g(c, t="string"):
        return F.col(c) if c in intel.columns else F.lit(None).cast(t)
    code = g("proxy_code", "bigint")
    is_proxy = code.isin(PROXY_CODES)
    return intel.select(
        F.col("ip"),
        g("fraud_score", "bigint").alias("ipqs_fraud_score"), g("vpn", "bigint").alias("ipqs_vpn"),
        g("proxy", "bigint").alias("ipqs_proxy"), g("tor", "bigint").alias("ipqs_tor"),
        g("connection_type").alias("ipqs_connection_type"),
        F.when(code.isNull(), F.lit(None)).when(is_proxy, F.lit(1)).otherwise(F.lit(0)).alias("ip2proxy_is_proxy"),
        F.when(is_proxy, g("proxy_type")).alias("ip2proxy_proxy_type"),
        F.when(is_proxy, g("country")).alias("ip2proxy_country"),
        F.when(is_proxy, g("usage_type")).alias("ip2proxy_usage_type"),
    )


def enrich_flows(flows: DataFrame, intel: DataFrame, *, private_rule: str | None = "python") -> DataFrame:
    """Attributes of both ends with src_/dst_ prefixes (J3): the flows are
    joined to the reputation table once per end, and Spark chooses the join by
    the table's size. A private IP carries is_private alone (private_rule=None:
    no short-cut); an unknown one has NULL attributes, as has a NULL address."""
    dim, out = intel_attributes(intel), flows
    for side in ("src", "dst"):
        ip = F.col(f"{side}_ip")
        found = dim.select(F.col("ip").alias(f"{side}_ip"), *[F.col(c).alias(f"_{side}_{c}") for c in INTEL_ATTRS])
        private = is_private(ip, private_rule) if private_rule else F.lit(False)
        private = F.when(ip.isNotNull(), private.cast("int"))
        out = out.join(found, on=f"{side}_ip", how="left").withColumn(f"{side}_is_private", private)
        out = out.withColumns({f"{side}_{c}": F.when(F.col(f"{side}_is_private") == 0, F.col(f"_{side}_{c}"))
                               for c in INTEL_ATTRS}).drop(*[f"_{side}_{c}" for c in INTEL_ATTRS])
    return out
