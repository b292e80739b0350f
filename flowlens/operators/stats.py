"""Exact quantiles at scale and IQR outlier removal (A5)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import Scratch, materialize

#: A sketch of 2 * EXACT entries keeps every value of a range this long.
EXACT = 20_000
#: A pass leaves about a share of 6 / (100 * FANOUT) of the rows around a wanted position.
FANOUT = 32


def kth_smallest(df: DataFrame, col: str, ks: list[int], *, fanout: int = FANOUT, exact: int = EXACT) -> dict[int, float]:
    """Exact k-th smallest values (0-based) of a numeric column by iterated
    range narrowing: a mergeable quantile sketch proposes cut points, one
    grouped count places every wanted position in a range, and the search
    repeats inside each such range, whose few rows are written first. It ends where a range holds a single value
    (so a value repeated a billion times costs one pass, not one task) or so few
    rows that the sketch keeps them all and answers exactly. All positions
    share each pass, and only cut points and counts leave the executors."""
    base = df.select(F.col(col).cast("double").alias("x"))
    return _kth(base, sorted(set(ks)), fanout, exact, None)


def _rank_expr(x, cuts: list[float], lo: int = 0, hi: int | None = None):
    """Number of cut points < x, as a balanced comparison tree (log2 of the
    number of cuts comparisons per row)."""
    hi = len(cuts) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x > F.lit(cuts[mid]), _rank_expr(x, cuts, mid + 1, hi)).otherwise(_rank_expr(x, cuts, lo, mid))


def _cuts(x, probs: list[float], fanout: int):
    """Cut points of a column, values of it, on both sides of the wanted shares:
    from a mergeable sketch whose rank error is half of the distance."""
    accuracy = 100 * fanout
    around = sorted({min(1.0, max(0.0, p + d / accuracy)) for p in probs for d in (-2, 2)})
    return F.percentile_approx(x, around, accuracy)


def _from_sketch(cur: DataFrame, ranges: list[tuple], exact: int) -> dict[int, float]:
    """Positions of short ranges (condition, positions, offset, rows), all in
    one aggregate: with fewer rows than entries the sketch is exact."""
    aggs = [F.percentile_approx(F.when(cond, F.col("x")), [(k - off + 0.5) / n for k in ks], 2 * exact).alias(f"r{i}")
            for i, (cond, ks, off, n) in enumerate(ranges)]
    row = cur.agg(*aggs).first()
    return {k: float(v) for i, (_, ks, _, _) in enumerate(ranges) for k, v in zip(ks, row[f"r{i}"])}


def _kth(cur: DataFrame, ks: list[int], fanout: int, exact: int, stats) -> dict[int, float]:
    if stats is None:
        stats = cur.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first().asDict()
    if stats["lo"] == stats["hi"]:
        return {k: float(stats["lo"]) for k in ks}
    if stats["n"] <= exact:
        return _from_sketch(cur, [(F.lit(True), ks, 0, stats["n"])], exact)
    cuts = stats.get("cuts") or cur.select(_cuts(F.col("x"), [(k + 0.5) / stats["n"] for k in ks], fanout)).first()[0]
    cuts = sorted(set(float(c) for c in cuts))
    # key 2i: strictly between cut i-1 and cut i; key 2i+1: equal to cut i.
    # Cut points are data values, so every open range loses rows: progress.
    i = _rank_expr(F.col("x"), cuts)
    eq = F.coalesce(F.try_element_at(F.array(*[F.lit(c) for c in cuts]), i + 1) == F.col("x"), F.lit(False))
    key = i * 2 + eq.cast("int")
    counts = sorted((r["b"], r["n"]) for r in cur.groupBy(key.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    out, seen = {}, 0
    short, long = [], []
    for bi, n in counts:
        inside = [k for k in ks if seen <= k < seen + n]
        if inside:
            i, eq = divmod(bi, 2)
            if eq:
                out.update({k: cuts[i] for k in inside})
            else:
                cond = F.lit(True)
                if i > 0:
                    cond = cond & (F.col("x") > F.lit(cuts[i - 1]))
                if i < len(cuts):
                    cond = cond & (F.col("x") < F.lit(cuts[i]))
                (short if n <= exact else long).append((cond, inside, seen, n))
        seen += n
    if short:
        out.update(_from_sketch(cur, short, exact))
    for cond, inside, off, n in long:
        scratch = Scratch(cur.sparkSession, "quantile-range")
        part = scratch.write(cur.where(cond), "rows")  # later passes read these rows only
        found = _kth(part, [k - off for k in inside], fanout, exact, {"n": n, "lo": None, "hi": 0})
        scratch.keep_only()
        out.update({k: found[k - off] for k in inside})
    return out


def exact_quantiles(df: DataFrame, col: str, probs: list[float], stats=None) -> list[float | None]:
    """Linear-interpolation quantiles (pandas / DuckDB `quantile_cont`) of the
    non-NULL values, exactly (see `kth_smallest`); memory per task never
    depends on the number of distinct values, unlike the `percentile`
    aggregate, which merges a map of all of them in one task."""
    x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    if stats is None:
        stats = x.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first().asDict()
    n = stats["n"]
    if n == 0:
        return [None for _ in probs]
    want = {}
    for p in probs:
        h = (n - 1) * p
        lo = int(math.floor(h))
        want[p] = (lo, min(lo + 1, n - 1), h - lo)
    got = _kth(x, sorted({i for lo, hi, _ in want.values() for i in (lo, hi)}), FANOUT, EXACT, stats)
    return [got[lo] + (got[hi] - got[lo]) * frac for lo, hi, frac in (want[p] for p in probs)]


def approx_quantiles(df: DataFrame, col: str, probs: list[float], accuracy: int = 10_000) -> list[float | None]:
    """Mergeable-sketch quantiles: rank error <= n / accuracy."""
    r = df.select(F.percentile_approx(F.col(col).cast("double"), probs, accuracy).alias("q")).first()
    return list(r["q"]) if r and r["q"] is not None else [None for _ in probs]


# fixed values: columns never checked for outliers, plus the suffix rules
OUTLIER_EXCLUDED = ["src_port", "dst_port", "protocol", "vpn_flag", "ttl", "window_size", "mtu", "mss"]
OUTLIER_EXCLUDED_SUFFIXES = ("_count", "_flag")
NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float") 


def outlier_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Numeric columns, minus ids/ports/flags and *_count / *_flag (P20)."""
    ex = set(OUTLIER_EXCLUDED) | set(exclude or [])
    return [c for c, t in df.dtypes
            if (t in NUMERIC or t.startswith("decimal")) and c not in ex
            and not c.endswith(OUTLIER_EXCLUDED_SUFFIXES)]


def _column_stats(df: DataFrame, cols: list[str], chunk: int = 8, cuts: list[float] | None = None) -> dict:
    """std, count, min and max of several columns; a few columns per aggregate
    keep each generated aggregation method small. With `cuts` also the cut
    points with which a search for these quantiles begins."""
    out = {}
    for start in range(0, len(cols), chunk):
        part = cols[start:start + chunk]
        aggs = []
        for j, c in enumerate(part):
            x = F.col(c).cast("double")
            ok = x.isNotNull() & ~F.isnan(x)
            aggs += [F.stddev_samp(x).alias(f"sd{j}"), F.count_if(ok).alias(f"n{j}"),
                     F.min(F.when(ok, x)).alias(f"lo{j}"), F.max(F.when(ok, x)).alias(f"hi{j}")]
            if cuts:
                aggs.append(_cuts(F.when(ok, x), cuts, FANOUT).alias(f"cuts{j}"))
        r = df.agg(*aggs).first()
        out.update({c: {"sd": r[f"sd{j}"], "n": r[f"n{j}"], "lo": r[f"lo{j}"], "hi": r[f"hi{j}"],
                        "cuts": r[f"cuts{j}"] if cuts else None}
                    for j, c in enumerate(part)})
    return out


def remove_outliers(df: DataFrame, factor: float = 3.0, *, mode: str = "sequential",
                    method: str = "exact", columns: list[str] | None = None,
                    exclude: list[str] | None = None, checkpoint: bool = True) -> tuple[DataFrame, list[dict]]:
    """IQR rule: keep Q1 - f*IQR <= x <= Q3 + f*IQR; a column is skipped when
    its sample std is 0 or its IQR is 0 (A5).

    mode='sequential' computes each column's quartiles on the rows surviving
    the previous columns (reference, Q8); 'simultaneous' computes all bounds on
    the input and filters once. method='approx' uses the mergeable sketch.
    The input is checkpointed once (reliable storage under spark.checkpoint.dir)
    so that every per-column pass rescans it instead of its lineage.
    Returns the filtered frame and one bounds record per column.
    """
    cols = columns if columns is not None else outlier_columns(df, exclude)
    base = materialize(df, "outliers-input") if checkpoint else df
    q = exact_quantiles if method == "exact" else approx_quantiles
    cur, report, cond_all = base, [], F.lit(True)
    # one pass over the input: a column constant there stays constant on every
    # subset, so it is skipped without further jobs; the statistics stay valid
    # for later columns until a filter is applied
    stats: dict | None = _column_stats(base, cols) if cols else {}
    constant = {c for c, v in stats.items() if v["sd"] is not None and v["sd"] == 0}
    for c in cols:
        src = cur if mode == "sequential" else base
        if c in constant:
            report.append({"column": c, "std": 0.0, "q1": None, "q3": None, "applied": False})
            continue
        if stats is None:
            stats = _column_stats(src, [c], cuts=[0.25, 0.75] if method == "exact" else None)
        st = stats[c]
        sd = st["sd"]
        rec = {"column": c, "std": sd, "q1": None, "q3": None, "applied": False}
        if sd is not None and sd == 0:
            report.append(rec)
            continue
        q1, q3 = q(src, c, [0.25, 0.75], st) if method == "exact" else q(src, c, [0.25, 0.75])
        rec.update(q1=q1, q3=q3)
        if q1 is None or q3 - q1 == 0:
            report.append(rec)
            continue
        iqr = q3 - q1
        cond = F.col(c).between(F.lit(q1 - factor * iqr), F.lit(q3 + factor * iqr))
        rec["applied"] = True
        report.append(rec)
        if mode == "sequential":
            cur = cur.where(cond)
            stats = None
        else:
            cond_all = cond_all & cond
    return (cur if mode == "sequential" else base.where(cond_all)), report
