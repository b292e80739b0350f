"""Heterogeneous records -> one 11-column record table, then cleaned
(P1, P2, P11-P13, C3-C6, C13, C14, A1, T1, M1 entry point)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import parse as ps
from flowlens.operators.topk import first_per_key
from flowlens.sources.tables import spread

# fixed values (P1): the columns of a unified record, in order
UNIFIED_COLUMNS = ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_len",
                   "direction", "label", "source_type", "additional_meta"]
# fixed values (P1): accepted source names per unified field, first truthy wins
ALIASES = {
    "timestamp": ["timestamp", "time", "ts"],
    "src_ip": ["src_ip", "source_ip", "src"],
    "dst_ip": ["dst_ip", "destination_ip", "dst"],
    "src_port": ["src_port", "sport", "srcport"],
    "dst_port": ["dst_port", "dport", "dst_port", "dstport"],
    "protocol": ["protocol", "proto", "layer"],
    "packet_len": ["packet_len", "length", "pkt_len", "size"],
    "direction": ["direction"],
    "label": ["label", "class", "target"],
}
DEDUPE_KEY = ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_len"]
FALSY_TEXT = ["", "0"]


def truthy(c: Column) -> Column:
    """Python truthiness of a CSV-read value: NULL, '' and 0 are false."""
    s = c.cast("string")
    return F.when(s.isNotNull() & ~s.isin(FALSY_TEXT), s)


def normalize(records: DataFrame, source_type: str, *, keep: list[str] | None = None) -> DataFrame:
    """Resolve aliases (P1) and spill every other non-NULL field into a JSON
    string, '' when there is none (P2). `keep` lists bookkeeping columns
    (file, row number) carried through unchanged and left out of the spill."""
    records, keep = spread(records), list(keep or [])
    cols = set(records.columns)
    out = {}
    for field, names in ALIASES.items():
        present = [truthy(F.col(n)) for n in names if n in cols]
        out[field] = F.coalesce(*present, F.lit("")) if present else F.lit("")
    rest = [c for c in records.columns if c not in UNIFIED_COLUMNS and c not in keep]
    if rest:
        m = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]),
                         lambda k, v: v.isNotNull())
        meta = F.when(F.size(m) > 0, F.to_json(m)).otherwise(F.lit(""))
    else:
        meta = F.lit("")
    # two projections: the resolved alias is referenced several times by the
    # ISO conversion, so it is computed once first (keeps generated code small)
    resolved = records.select(*keep, *[out[f].alias(f) for f in ALIASES],
                              F.lit(source_type).alias("source_type"), meta.alias("additional_meta"))
    return resolved.withColumn("timestamp", ps.to_iso(F.col("timestamp"))).select(*keep, *UNIFIED_COLUMNS)


def dedupe_records(df: DataFrame, order_cols: list) -> DataFrame:
    """Keep-first on the 7 record columns under an explicit order (A1)."""
    return first_per_key(df, DEDUPE_KEY, order_cols)


def sort_by_time(df: DataFrame) -> DataFrame:
    """Order by parsed timestamp, missing/unparsable first."""
    return df.orderBy(ps.parse_ts(F.col("timestamp"), ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                                                       "yyyy-MM-dd'T'HH:mm:ss"]).asc_nulls_first())


def unify(records: DataFrame, source_type: str, order_cols: list, keep: list[str] | None = None) -> DataFrame:
    """normalize -> dedupe -> sort (the unify step)."""
    return sort_by_time(dedupe_records(normalize(records, source_type, keep=keep), order_cols))


def preprocess(unified: DataFrame, order_cols: list, *, drop_unlabeled: bool = False,
               negatives_first: bool = False) -> DataFrame:
    """Types, protocol, labels, filters and dedupe of unified records
    (P11, C14, C3, C4, C5, C6, P13, P12, A1).

    Essentials filter drops NULL *and* empty (Q10)."""
    d = unified
    for c in UNIFIED_COLUMNS:
        if c not in d.columns:
            d = d.withColumn(c, F.lit(""))  # P11
    # essentials (P12) are tested on the raw text: the ISO conversion maps
    # exactly the NULL/blank timestamps to ''. Filtering first keeps Catalyst
    # from pushing the converted expression down into the scan filter.
    ess = F.lit(True)
    for c in ("src_ip", "dst_ip", "timestamp"):
        ess = ess & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "" if c == "timestamp"
                                            else F.col(c) != "")
    d = d.where(ess)
    d = d.withColumns({
        "timestamp": ps.to_iso(F.col("timestamp")),
        "src_port": ps.lenient_int(F.col("src_port"), -1),
        "dst_port": ps.lenient_int(F.col("dst_port"), -1),
        "packet_len": ps.lenient_int(F.col("packet_len"), 0),
        "protocol": ps.norm_protocol(F.col("protocol")),
        "label": ps.standardize_label(F.col("label")),
    })
    d = d.withColumns({"protocol_num": ps.protocol_number(F.col("protocol")),
                       "label_num": ps.infer_label_num(F.col("label"), negatives_first)})
    if drop_unlabeled:
        d = d.where(F.col("label_num").isNotNull())
    return dedupe_records(d, order_cols)
