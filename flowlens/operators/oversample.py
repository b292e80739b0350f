"""Synthetic minority oversampling (D10) over an exact nearest-neighbour join.

Neighbours are found inside a class only, in cells around pivots:

1. Equal feature vectors are one point, however many rows have them, so a
   value that a third of a class shares costs one point.
2. Pivots are points picked by their hash, about one for CELL points and
   PIVOTS in all at most; every point belongs to its nearest pivot's cell.
   Pivots and the radii of their cells are the only tables that reach the
   driver.
3. Every point looks among its own cell's points first; its k-th distance
   bounds what any other cell has to offer. It then visits only the cells that
   the triangle inequality (distance to the pivot less the cell's radius, and
   the distance to the plane between the two pivots) leaves possible.
4. The best k of all visits are merged by point.

Cells are visited in chunks of CHUNK points, so a crowded cell is worked on by
several tasks, and distances are taken in blocks of bounded size. The result is
exact and the same for any pivots; beyond PIVOTS x CELL points the cells grow,
and PIVOTS should.

Synthetic rows: each row of a class below the target gives as many as the
others, the remainder to the first by digest; one lies at a random place, by a
seeded digest, between the row and one of its k nearest points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.split import hash_order
from flowlens.operators.topk import ordinal_within_group
from flowlens.session import Scratch, configure

PIVOTS = 4096
CELL = 1024
CHUNK = 8192
#: Distances held at a time.
BLOCK = 1 << 22
#: Bounds are widened by this share against rounding.
SLACK = 1e-9

_POINT = "cls string, pid string, x array<double>"


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over the features from the first to the last, without the product
    form, so that they equal the same sums elsewhere."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        total += (a[:, k, None] - b[None, :, k]) ** 2
    return total


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, width))


def _blocks(n: int, others: int) -> Iterator[slice]:
    step = max(1, BLOCK // max(1, others))
    for i in range(0, n, step):
        yield slice(i, i + step)


def _pivots(points: DataFrame, cell: int, limit: int) -> dict[str, np.ndarray]:
    """At least one point of every class, about one of `cell`, and up to
    `limit` in all (one row more for each class)."""
    sizes = {r.cls: r.n for r in points.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    share = min(1.0 / cell, limit / sum(sizes.values()))
    place = F.pmod(F.xxhash64("pid"), F.lit(1 << 30))
    first = points.groupBy("cls").agg(F.min_by("pid", F.struct(place, "pid")).alias("pid"))
    more = points.where(place < int(share * (1 << 30))).select("cls", "pid")
    chosen = points.join(first.unionByName(more).distinct(), ["cls", "pid"], "left_semi").orderBy("cls", "pid").collect()
    return {c: np.array([r.x for r in chosen if r.cls == c]) for c in sizes}


def _visit(k: int, width: int):
    """The best k members of a cell for each query that visits it, itself excluded."""
    def best(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("pid")  # ties go to the smallest pid
        names, at = members["pid"].to_numpy(), _matrix(members["x"], width)
        own = pd.Index(names).get_indexer(queries["pid"])  # -1: not a member
        out: list[tuple] = []
        pids, q = queries["pid"].to_numpy(), _matrix(queries["x"], width)
        for part in _blocks(len(q), len(at)):
            d = squared_distances(q[part], at)
            inside = np.flatnonzero(own[part] >= 0)
            d[inside, own[part][inside]] = np.inf
            # the k-th distance ends each row's choice, so that only few are sorted
            last = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
            i, j = np.nonzero((d <= last[:, None]) & np.isfinite(d))
            order = np.lexsort((j, d[i, j], i))
            i, j = i[order], j[order]
            ends = np.searchsorted(i, np.arange(len(d) + 1))
            for row, pid in enumerate(pids[part]):
                o = j[ends[row]:min(ends[row] + k, ends[row + 1])]
                out.append((pid, d[row, o].tolist(), names[o].tolist()))
        return pd.DataFrame(out, columns=["pid", "d2", "near"])
    return best


def nearest_in_class(points: DataFrame, k: int, scratch: Scratch, *, cell: int = CELL, pivots: int = PIVOTS,
                     chunk: int = CHUNK) -> DataFrame:
    """(cls, pid, x) with distinct pid and, within a class, distinct x ->
    (pid, near): the pids of the k nearest others of the class, by distance and
    pid; fewer where the class has fewer."""
    spark = points.sparkSession
    points = scratch.write(points.select("cls", "pid", "x"), "points")
    table = _pivots(points, cell, pivots)
    width = max((p.shape[1] for p in table.values()), default=0)
    shared = spark.sparkContext.broadcast(table)  # PIVOTS points and one a class at the most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, part in pdf.groupby("cls"):
                x, p = _matrix(part["x"], width), shared.value[c]
                for rows in _blocks(len(x), len(p)):
                    d = squared_distances(x[rows], p)
                    near = d.argmin(axis=1)
                    yield part.iloc[rows].assign(cell=near.astype(np.int32), r=np.sqrt(d.min(axis=1)))

    dealt = scratch.write(points.mapInPandas(assign, f"{_POINT}, cell int, r double"), "dealt")
    cells = dealt.groupBy("cls", "cell").agg(F.max("r").alias("radius"))
    radius = {c: np.full(len(p), -1.0) for c, p in table.items()}
    for row in cells.collect():  # one row a pivot
        radius[row.cls][row.cell] = row.radius
    radii = spark.sparkContext.broadcast(radius)

    best = _visit(k, width)
    found = "pid string, d2 array<double>, near array<string>"
    key = ["cls", "cell", "chunk"]

    def visits(queries: DataFrame, name: str) -> DataFrame:
        """Queries (cls, cell, pid, x) against the members of the cells, in
        chunks of the queries of a cell."""
        most = queries.groupBy("cls", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("parts"))
        asked = queries.join(most, ["cls", "cell"]).select(
            "cls", "cell", F.pmod(F.xxhash64("pid"), "parts").cast("int").alias("chunk"), "pid", "x")
        # read anew, so that both sides of the cogroup have columns of their own
        members = spark.read.schema(dealt.schema).parquet(scratch.path("dealt")).join(most, ["cls", "cell"]).select(
            "cls", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), "pid", "x")
        return scratch.write(asked.groupBy(*key).cogroup(members.groupBy(*key)).applyInPandas(best, found), name)

    own = visits(dealt.select("cls", "cell", "pid", "x"), "own")
    kth = F.when(F.size("d2") == k, F.sqrt(F.element_at("d2", k)))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, part in pdf.groupby("cls"):
                p, u = shared.value[c], radii.value[c]
                apart = np.sqrt(squared_distances(p, p))
                for rows in _blocks(len(part), len(p)):
                    some = part.iloc[rows]
                    at = some["cell"].to_numpy()
                    d2 = squared_distances(_matrix(some["x"], width), p)
                    mine = d2[np.arange(len(some)), at]
                    between = apart[at]
                    plane = np.divide(d2 - mine[:, None], 2 * between, out=np.zeros_like(d2), where=between > 0)
                    least = np.maximum(np.sqrt(d2) - u[None, :], plane)
                    bound = some["t"].fillna(np.inf).to_numpy()
                    go = (least * (1 - SLACK) <= bound[:, None]) & (u[None, :] >= 0)
                    go[np.arange(len(some)), at] = False
                    i, s = np.nonzero(go)
                    yield some.iloc[i][["cls", "pid", "x"]].assign(cell=s.astype(np.int32))

    asked = dealt.join(own.select("pid", kth.alias("t")), "pid").select("cls", "pid", "x", "cell", "t")
    away = visits(scratch.write(asked.mapInPandas(others, f"{_POINT}, cell int"), "asked"), "away")
    pairs = own.unionByName(away).select("pid", F.explode(F.arrays_zip("d2", "near")).alias("pair"))
    # at most k for each cell visited
    merged = pairs.groupBy("pid").agg(F.slice(F.array_sort(F.collect_list("pair")), 1, k).alias("pairs"))
    return points.select("pid").join(merged, "pid", "left").select(
        "pid", F.coalesce(F.col("pairs.near"), F.array().cast("array<string>")).alias("near"))


def smote(df: DataFrame, label_col: str, key_cols: list[str], features: list[str], *, target_ratio: float = 0.2,
          k: int = 5, seed: int = 42, cell: int = CELL, pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """Synthetic rows that bring every class up to `target_ratio` of the
    largest: label, the keys of the row that each starts from, copy (from 1),
    near (digest of the neighbour), features. Rows with a null label or feature
    take no part. A class of a single point is copied; no rows give none."""
    spark = configure(df.sparkSession)
    scratch = Scratch(spark, "smote")
    x = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in features])  # -0.0 is 0.0
    rows = df.where(F.col(label_col).isNotNull()).dropna(subset=features).select(
        F.col(label_col).cast("string").alias("cls"), *key_cols, x.alias("x"))
    sizes = {r.cls: r.n for r in rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    target = int(target_ratio * max(sizes.values(), default=0))
    wanted = {c: (target - n) for c, n in sizes.items() if n < target}
    lacking = F.create_map(*[F.lit(v) for kv in wanted.items() for v in kv]) if wanted else None
    # digests and a stage of their own for the rows of the classes to fill only
    minor = scratch.write(rows.where(F.col("cls").isin(list(wanted))).withColumn("h", hash_order(key_cols, seed)), "rows")

    points = minor.groupBy("cls", "x").agg(F.min("h").alias("pid"))
    near = nearest_in_class(points, k, scratch, cell=cell, pivots=pivots, chunk=chunk)
    points = spark.read.parquet(scratch.path("points"))

    bucket = F.conv(F.substring("h", 1, 4), 16, 10).cast("bigint")
    dealt = ordinal_within_group(minor, ["cls"], ["h", *key_cols], bucket, name="ord")
    more = F.element_at(lacking, F.col("cls")) if wanted else F.lit(0)
    copies = F.floor(more / F.col("ord_group_size")) + (F.col("ord") < more % F.col("ord_group_size")).cast("int")
    starts = dealt.withColumn("copies", copies.cast("int")).where("copies > 0") \
        .join(points, ["cls", "x"]).join(near, "pid") \
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))) \
        .withColumn("draw", F.md5(F.concat_ws("|", F.col("h"), F.col("copy").cast("string"))))

    def number(start: int, digits: int) -> F.Column:
        return F.conv(F.substring("draw", start, digits), 16, 10).cast("bigint")

    picked = starts.withColumn("to", F.when(F.size("near") > 0, F.element_at(
        "near", (F.pmod(number(1, 8), F.greatest(F.size("near"), F.lit(1))) + 1).cast("int"))).otherwise(F.col("pid"))) \
        .withColumn("u", number(9, 13).cast("double") / F.lit(float(16 ** 13)))
    ends = points.select(F.col("pid").alias("to"), F.col("x").alias("y"))
    out = picked.join(ends, "to").withColumn("z", F.zip_with("x", "y", lambda a, b: a + (b - a) * F.col("u")))
    return scratch.write(out.select(F.col("cls").alias(label_col), *key_cols, "copy", F.col("to").alias("near"),
                                    *[F.col("z")[i].alias(c) for i, c in enumerate(features)]), "synthetic")
