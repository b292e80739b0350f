"""Packet-block images (C30-C32, F14) and byte-token samples.

A flow image is 64x64 pixels, one pixel per packet in flow order:
R = client->server size, G = server->client size (both capped at 1500 and
scaled to 255), B = gap to the previous packet (capped at 1 s, scaled).
Only the first size*size packets of a flow can appear, so they are picked
with a skew-safe top-n before any per-flow window; a flow's pixel list is
therefore bounded by 4096 entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators import flows as fl
from flowlens.operators.topk import ordinal_within_group, top_n_per_group

FLOW_COLS = [*fl.KEY, "sid"]
PROTO_NAMES = {6: "TCP", 17: "UDP"}


def block_flows(packets: DataFrame, *, timeout: float = 60.0, min_packets: int = 3, bucket=None) -> DataFrame:
    """TCP/UDP packets -> endpoint-keyed sessions (F1 'endpoint', F2), with
    the flow's packet count; flows under `min_packets` dropped."""
    keyed = fl.canonical_key(packets.where(F.col("protocol").isin(list(PROTO_NAMES))), "endpoint")
    s = fl.sessionize(keyed, timeout, bucket=bucket)
    sizes = s.groupBy(*FLOW_COLS).agg(F.count(F.lit(1)).alias("flow_packets"))
    return s.join(sizes.where(F.col("flow_packets") >= min_packets), on=FLOW_COLS, how="inner")


def pixels(sessions: DataFrame, *, size: int = 64, max_pkt_size: int = 1500, max_gap: float = 1.0) -> DataFrame:
    """One row per pixel: flow, idx, row, col, r, g, b (C30; W1, W3, W4).

    Channel values follow the reference's float32 accumulation: the double
    value is rounded to float32, clipped to [0, 255] and truncated.
    """
    firsts = top_n_per_group(sessions, FLOW_COLS, ["o"], size * size)
    w = Window.partitionBy(*FLOW_COLS).orderBy("o")
    ep = F.struct("src_ip", "src_port")
    d = firsts.select(
        *FLOW_COLS, "o", "src_ip", "src_port", "pkt_len",
        (F.row_number().over(w) - 1).alias("idx"),
        F.lag("o").over(w).alias("_prev"),
        F.first(ep).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_client"),
    )
    c2s = ep == F.col("_client")
    norm = F.least(F.col("pkt_len"), F.lit(max_pkt_size)).cast("double") / F.lit(float(max_pkt_size))
    val = norm * F.lit(255.0)
    delta = F.coalesce((F.col("o.ts_us") - F.col("_prev.ts_us")) / F.lit(1_000_000.0), F.lit(0.0))
    bval = F.least(delta, F.lit(float(max_gap))) / F.lit(float(max_gap)) * F.lit(255.0)

    def chan(x):
        return F.greatest(F.least(x.cast("float").cast("double"), F.lit(255.0)), F.lit(0.0)).cast("int")
    return d.select(
        *FLOW_COLS, "idx", (F.col("idx") / size).cast("int").alias("row"), (F.col("idx") % size).alias("col"),
        chan(F.when(c2s, val).otherwise(F.lit(0.0))).alias("r"),
        chan(F.when(~c2s, val).otherwise(F.lit(0.0))).alias("g"),
        chan(bval).alias("b"),
    )


def images(pix: DataFrame, size: int = 64) -> DataFrame:
    """Assemble H x W x 3 images (flattened row-major, channel last), zero
    padded; all-black images dropped (C31). Each group holds <= size*size
    pixels by construction."""
    g = pix.groupBy(*FLOW_COLS).agg(
        F.map_from_entries(F.collect_list(F.struct("idx", F.array("r", "g", "b")))).alias("_m"),
        F.sum(F.col("r") + F.col("g") + F.col("b")).alias("_total"),
        F.count(F.lit(1)).alias("packets_drawn"))
    zero = F.array(F.lit(0), F.lit(0), F.lit(0))
    img = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)),
                                lambda i: F.coalesce(F.element_at(F.col("_m"), i), zero)))
    return g.where(F.col("_total") > 0).select(*FLOW_COLS, "packets_drawn", img.alias("image"))


def scale_pixels(image_col) -> F.Column:
    """uint8 pixels -> float32 in [0, 1]."""
    return F.transform(image_col, lambda x: (x / F.lit(255.0)).cast("float"))


def iso_z(ts_us) -> F.Column:
    t = F.timestamp_micros(ts_us)
    return F.concat(F.regexp_replace(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit("Z"))


def manifest(sessions: DataFrame, pix: DataFrame, capture: str = "capture") -> DataFrame:
    """One row per saved image (F14): file name with a per-capture sequence
    number in flow-start order, endpoint key, protocol name, first/last
    packet time (ISO + 'Z') and the flow's full packet count. All-black
    images are skipped, as no file is written for them."""
    lit_black = pix.groupBy(*FLOW_COLS).agg(F.sum(F.col("r") + F.col("g") + F.col("b")).alias("_total")) \
        .where(F.col("_total") > 0).drop("_total")
    f = sessions.groupBy(*FLOW_COLS).agg(F.min("o").alias("_first"), F.max("o").alias("_last"),
                                         F.count(F.lit(1)).alias("num_packets"))
    f = f.join(lit_black, on=FLOW_COLS, how="inner").withColumn("_cap", F.lit(capture))
    hour = F.floor(F.col("_first.ts_us") / F.lit(3_600_000_000)).cast("bigint")
    f = ordinal_within_group(f, ["_cap"], ["_first", *fl.KEY], hour, name="_seq")
    proto = F.when(F.col("protocol") == 6, F.lit("TCP")).when(F.col("protocol") == 17, F.lit("UDP")) \
        .otherwise(F.col("protocol").cast("string"))
    return f.select(
        F.format_string("flow_%s_%07d.png", F.col("_cap"), F.col("_seq")).alias("image_filename"),
        F.col("ip1").alias("src_ip"), F.col("port1").alias("src_port"),
        F.col("ip2").alias("dst_ip"), F.col("port2").alias("dst_port"), proto.alias("protocol"),
        iso_z(F.col("_first.ts_us")).alias("start_ts"), iso_z(F.col("_last.ts_us")).alias("end_ts"),
        "num_packets")


# ------------------------------------------------------------------ C12 / S8 / S12
def class_index(df: DataFrame, class_col: str) -> DataFrame:
    """Class name -> index by sorted name (S8): computed on the distinct
    class table (one row per class), then joined back."""
    names = df.select(class_col).distinct()
    idx = names.withColumn("label", F.row_number().over(Window.orderBy(class_col)) - 1)
    return df.join(idx, on=class_col, how="inner")


def token_samples(payloads: DataFrame, class_col: str, max_tokens: int = 128) -> DataFrame:
    """(label, text_a): class index and the first `max_tokens` bytes as
    space-separated lower-case hex tokens (C12)."""
    from flowlens.functions.parse import hex_tokens
    return class_index(payloads, class_col).select("label", hex_tokens(F.col("payload"), max_tokens).alias("text_a"),
                                                   *[c for c in payloads.columns if c not in ("payload",)])


def write_tsv(samples: DataFrame, path: str, with_label: bool = True) -> None:
    """TSV sink `label<TAB>text_a` with header; label-less projection."""
    cols = ["label", "text_a"] if with_label else ["text_a"]
    samples.select(*cols).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
