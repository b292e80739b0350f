"""Headline-query benchmark.

Runs the main flowlens jobs over $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and prints one JSON line. Every query is executed in
full with the `noop` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowlens.plans import catalog  # noqa: E402
from flowlens.session import local_session  # noqa: E402

HEADLINE = [
    "f2_sessionize",        # packets -> flows (60 s idle gap)
    "f11_nfstream_flows",   # packets -> NFStream-style families
    "c25_extract_all",      # full derived feature block
    "f13_payload_entropy",  # payload byte entropy per endpoint pair
    "c26_firewall_flows",   # key=value logs -> flows
    "c6_preprocess_records",  # record unification + cleaning
    "p7_align_flows",       # alignment to the core schema
    "u1_merge_sources",     # merge of aligned sources
    "a2_dedupe_flows",      # keep-first 5-tuple dedupe
    "a5_iqr_outliers",      # sequential exact IQR outliers
    "m1_stratified_split",  # stratified 70/15/15 split
    "j3_enrich_ips",        # reputation join on both ends
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=cpus * 2, app="flowlens-bench")
    # untimed warm-up: JVM code paths, Python workers and the file listing cache
    spark.range(100_000).selectExpr("sum(id)").collect()
    spark.read.parquet(f"{sf_dir}/region.parquet").collect()
    times: dict[str, float] = {}
    for name in names:
        fn = catalog.QUERIES[name]
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    n_packets = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    n_flows_in = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    total = round(sum(times.values()), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {
        "metric": "headline_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "packets_per_sec_f2": round(n_packets / times["f2_sessionize"], 1) if "f2_sessionize" in times else None,
        "align_rows_per_sec_p7": round(n_flows_in / times["p7_align_flows"], 1) if "p7_align_flows" in times else None,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
