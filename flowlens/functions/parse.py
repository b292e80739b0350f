"""Parsing, label and protocol functions (C1-C15). All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions.exprs import col

# fixed values (C1): key=value with optional double-quoted value
KV_PATTERN = r'(\w+)=(?:"([^"]*)"|([^\s]+))'
# fixed values (C4, C5): protocol names and numbers
PROTO_NUMBERS = {"TCP": 6, "UDP": 17, "ICMP": 1}
# fixed values (C6): label tokens, positives tested first by substring
LABEL_POSITIVE_TOKENS = ["vpn", "anonym", "proxy", "tor"]
LABEL_NEGATIVE_TOKENS = ["novpn", "benign", "normal", "nonvpn", "clear"]
LABEL_TRUE_WORDS = ["1", "true", "yes", "positive"]
LABEL_FALSE_WORDS = ["0", "false", "no", "negative"]
# fixed values (C14): accepted timestamp layouts, tried in this order
ISO_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss",
               "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSSSS"]


# ------------------------------------------------------------------ C1
def kv_map(line) -> Column:
    """`key=value key="quoted value"` -> MAP<STRING,STRING>.

    A non-empty quoted value wins over the unquoted one; a repeated key keeps
    its last value (session conf mapKeyDedupPolicy=LAST_WIN); blank lines,
    '#' lines and lines without a pair give NULL. `(?U)` makes `\\w` Unicode
    as in Python.
    """
    s = col(line)
    pat = "(?U)" + KV_PATTERN
    # one regex pass: every whole `key=value` match, then split at the first '='
    pairs = F.regexp_extract_all(s, F.lit(pat), 0)
    def entry(x):
        k = F.substring_index(x, "=", 1)
        rest = F.substring(x, F.length(k) + 2, F.lit(1 << 30))
        quoted = rest.startswith('"') & rest.endswith('"') & (F.length(rest) >= 2)
        return F.struct(k.alias("k"), F.when(quoted, F.substring(rest, F.lit(2), F.length(rest) - 2))
                        .otherwise(rest).alias("v"))
    entries = F.transform(pairs, entry)
    skip = (F.trim(s) == "") | s.startswith("#") | (F.size(pairs) == 0)
    return F.when(~skip, F.map_from_entries(entries))


# ------------------------------------------------------------------ C3 / C4 / C5
def lenient_int(c, default: int) -> Column:
    """int(float(x)); '' / NULL / junk -> default."""
    d = col(c).cast("string").try_cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(9.2e18))
    return F.when(ok, d.cast("bigint")).otherwise(F.lit(default)).cast("bigint")


def norm_protocol(c) -> Column:
    """Upper-case; digits -> name via {6,17,1} else the digits; 'TCP/HTTP' -> 'TCP'; NULL -> '' (C4)."""
    s = F.upper(col(c).cast("string"))
    by_num = None
    for name, num in PROTO_NUMBERS.items():
        by_num = (F.when(s == F.lit(str(num)), F.lit(name)) if by_num is None
                  else by_num.when(s == F.lit(str(num)), F.lit(name)))
    by_num = by_num.otherwise(s)
    return (F.when(s.isNull(), F.lit(""))
             .when(s.rlike("^[0-9]+$"), by_num)
             .otherwise(F.split_part(s, F.lit("/"), F.lit(1))))


def protocol_number(c) -> Column:
    """Protocol name -> number, unknown or empty -> 0."""
    s = F.upper(col(c).cast("string"))
    out = None
    for name, num in PROTO_NUMBERS.items():
        out = F.when(s == name, F.lit(num)) if out is None else out.when(s == name, F.lit(num))
    return out.otherwise(F.lit(0)).cast("bigint")


# ------------------------------------------------------------------ C6 / C7 / C8 / C9
def standardize_label(c) -> Column:
    """trim + lower; NULL -> '' (C6)."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))), F.lit(""))


def infer_label_num(c, negatives_first: bool = False) -> Column:
    """0/1/NULL from a standardized label: positive tokens by substring,
    then negative tokens, then exact words (C6). The default tests positives
    first, so 'novpn' -> 1 (Q9); negatives_first=True fixes that."""
    s = col(c)

    def any_token(tokens):
        e = F.lit(False)
        for t in tokens:
            e = e | s.contains(t)
        return e
    pos, neg = any_token(LABEL_POSITIVE_TOKENS), any_token(LABEL_NEGATIVE_TOKENS)
    first, second = ((neg, 0), (pos, 1)) if negatives_first else ((pos, 1), (neg, 0))
    return (F.when(s.isNull() | (s == ""), F.lit(None))
             .when(first[0], F.lit(first[1]))
             .when(second[0], F.lit(second[1]))
             .when(s.isin(LABEL_TRUE_WORDS), F.lit(1))
             .when(s.isin(LABEL_FALSE_WORDS), F.lit(0))
             .otherwise(F.lit(None))).cast("int")


def is_vpn_target(c) -> Column:
    """Binary target: upper(label) starts with 'VPN' (C7)."""
    return F.upper(col(c).cast("string")).startswith("VPN").cast("int")


def label_from_file_stem(path) -> Column:
    """'.../DoS-Wednesday-no-metadata.parquet' -> 'DoS Wednesday' (C8)."""
    stem = F.regexp_extract(col(path), r"([^/]+?)(\.[^./]*)?$", 1)
    return F.regexp_replace(F.regexp_replace(stem, "-no-metadata$", ""), "-", " ")


def label_from_image_name(name) -> Column:
    """2nd '_' token without '.pcap' (C9)."""
    return F.regexp_replace(F.split_part(col(name), F.lit("_"), F.lit(2)), r"\.pcap", "")


# ------------------------------------------------------------------ C10
def flow_id(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port",
            protocol: str | None = "protocol") -> Column:
    """'src:sp-dst:dp-proto', or the directed id without protocol."""
    if protocol is None:
        return F.format_string("%s:%s-%s:%s", src_ip, src_port, dst_ip, dst_port)
    return F.format_string("%s:%s-%s:%s-%s", src_ip, src_port, dst_ip, dst_port, protocol)


# ------------------------------------------------------------------ C12
def hex_tokens(payload, max_tokens: int = 128) -> Column:
    """First `max_tokens` payload bytes as space-joined lower-case hex pairs."""
    h = F.lower(F.hex(F.substring(col(payload), 1, max_tokens)))
    return F.array_join(F.regexp_extract_all(h, F.lit("(..)"), 1), " ")


# ------------------------------------------------------------------ C13 / C14 / C15
def iso_text(ts) -> Column:
    """TIMESTAMP -> 'YYYY-MM-DDTHH:MM:SS[.ffffff]' (fraction only when non-zero,
    like Python's isoformat). One reference to `ts`, so nesting stays small."""
    return F.regexp_replace(F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def parse_ts(c, formats=ISO_FORMATS) -> Column:
    """First format that parses, else NULL (C14)."""
    s = col(c).cast("string")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])


def to_iso(c, formats=ISO_FORMATS) -> Column:
    """Epoch number -> UTC ISO; text in a known layout -> ISO; other text kept
    as is; NULL/'' -> '' (C13, C14). Free-form parsing is narrowed to
    `formats` (documented divergence). Epoch seconds round to the nearest
    microsecond, as Python's conversion does."""
    s = F.trim(col(c).cast("string"))
    micros = F.round(s.try_cast("double") * F.lit(1_000_000.0)).try_cast("bigint")
    return F.coalesce(
        F.when(F.coalesce(s, F.lit("")) == "", F.lit("")),
        iso_text(F.timestamp_micros(micros)),
        iso_text(parse_ts(s, formats)),
        s,
    )


def date_time_ts(date_col, time_col) -> Column:
    """date 'yyyy-MM-dd' + time 'HH:mm:ss' -> TIMESTAMP, else NULL."""
    d, t = col(date_col), col(time_col)
    ok = (F.coalesce(d, F.lit("")) != "") & (F.coalesce(t, F.lit("")) != "")
    return F.when(ok, F.try_to_timestamp(F.concat_ws(" ", d, t), F.lit("yyyy-MM-dd HH:mm:ss")))


def calendar_parts(ts) -> dict[str, Column]:
    """hour, weekday (Mon=0) and weekend flag (C17)."""
    t = col(ts)
    wd = F.weekday(t)
    return {"hour": F.hour(t), "weekday": wd, "is_weekend": wd.isin(5, 6).cast("int")}
