"""Similarity join of documents on n-gram sets with a count-vector R-tree.

The shingles of a document are hashed into groups; the group counts are its
point. For two points the sum of the coordinate-wise minima is an upper bound
of the number of shared shingles, so pairs (and, with the maxima of a box,
whole boxes) whose bound lies under the wanted overlap are left out, and only
the pairs that survive are compared set by set.

How it runs on Spark:

1. `points`: every text becomes one narrow row with its set's fingerprint,
   size and group counts. Texts with equal sets are one point from here on,
   however many rows they have.
2. Top level of the tree, dealt over the cluster: over the finest groups (one
   per shingle hash) two linked sets must both be non-zero in one of the first
   n - ceil(t n) + 1 coordinates of each, for any order of the coordinates, as
   the minima over the others sum to less than the wanted overlap. A cell holds
   the points with one such coordinate. Coordinates are ordered from rare to
   frequent (fixed-size tables of shingle and word counts over all documents),
   so passages that many documents share and runs of common words come last and
   rarely make a cell. A frequent coordinate's cell is dealt out in parts of
   bounded size.
3. Anchors: every point is compared with its cells' anchors (the cell's
   smallest fingerprint). That joins most of a group of copies by few
   comparisons for each member.
4. Cells that still hold several components are searched with an R-tree
   bulk-loaded over their points, in blocks of bounded size: first for the
   likeliest links between components, then, where there were any, for all
   pairs that the bound leaves between the components that remain. A pair comes
   out of the first cell that both points are in, and out of no other.
5. Surviving pairs are verified on the whole sets, and components follow.
6. `jaccard_links` also counts links: two linked sets lie in one component, so
   the sets of a component are dealt out in pairs of blocks of bounded size, and
   a task counts the shared shingles of every pair of sets of its two blocks,
   each pair in one task. Its work grows with the square of a component's
   different sets, its rows with a set's number of blocks.

Defined results: null, empty and blank texts have no shingles, size 0 and are
linked with nothing; rows with equal sets are linked, also when all columns
repeat, a null id included; an empty table gives an empty result. Other
columns of the input are not looked at. Sets are told apart by a 64-bit
fingerprint, shingles by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.components import components
from flowlens.llm.text import U, groups, shingle_sets, trimmed, utf8, words
from flowlens.session import Scratch, configure

#: Least groups of a point; longer sets have more (a power of two, so that a
#: count is about 4 at most). A count is one byte, 255 meaning "at least that".
GROUPS = 256
#: Entries of the tables of shingle and word counts that give the coordinates' order.
COUNTS = 1 << 17
WORD_COUNTS = 1 << 16
#: Points of one block of the search in a cell.
BLOCK = 1024
#: Shingles of one block of the count of links, about, and steps of its work.
BLOCK_SHINGLES = 1 << 20
DENSE = 1 << 13
AT_ONCE = 1 << 22
FANOUT = 32
PAIRS_AT_ONCE = 4096
#: Bits of the table that keeps texts from being read for nothing.
SLOTS = 1 << 24


class Rule:
    """100 * intersection >= percent * union, in integers."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: int) -> int:
        """Coordinates of a set of n among which a linked set must share one."""
        return n - (self.percent * n + 99) // 100 + 1

    def enough(self, overlap, na, nb):
        """Also for upper bounds of the overlap, and for Spark columns."""
        return (100 + self.percent) * overlap >= self.percent * (na + nb)

    def sizes(self, na, nb):
        return (100 * na >= self.percent * nb) & (100 * nb >= self.percent * na)


def _point(values: np.ndarray) -> np.ndarray:
    groups_of = max(GROUPS, 1 << max(0, (len(values) // 4 - 1)).bit_length())
    counts = np.bincount((values & U(groups_of - 1)).astype(np.int64), minlength=groups_of)
    return np.minimum(counts, 255).astype(np.uint8)


def _folded(vectors: np.ndarray, groups_of: int) -> np.ndarray:
    """The same points over fewer groups."""
    if vectors.shape[1] == groups_of:
        return vectors
    return np.minimum(vectors.reshape(len(vectors), -1, groups_of).sum(1, dtype=np.int64), 255).astype(np.uint8)


def _minima(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed minima over the last axis; without limit where both counts of a
    group are cut off at 255."""
    low = np.minimum(x, y)
    total = low.sum(-1, dtype=np.int64)
    if low.size and low.max() == 255:
        total[low.max(-1) == 255] = np.iinfo(np.int32).max
    return total


def _fingerprint(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def _sets(batch: pa.RecordBatch, n: int, weight: np.ndarray | None = None, word_counts: np.ndarray | None = None):
    """Distinct shingle hashes in order, and their weights, of the second
    column's texts; words are added up in `word_counts`."""
    data, offsets = utf8(batch.column(1))
    for i, j in groups(offsets):
        w = words(data, offsets[i:j + 1])
        if word_counts is not None:
            word_counts += np.bincount((w.hash & U(WORD_COUNTS - 1)).astype(np.int64), minlength=WORD_COUNTS)
        yield from shingle_sets(w, n, weight)


def _bytes_column(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() if r is not None else None for r in rows], pa.binary())


def _vectors(column: pa.Array) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset:column.offset + len(column) + 1].tolist()
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [data[x:y] for x, y in zip(at[:-1], at[1:])]


POINTS = "id long, fp long, n int, point binary, bucket int, cnt long"


def points(docs: DataFrame, n: int) -> DataFrame:
    """(id, fp, n, point) of every row, and the counts of the coordinates'
    buckets as rows (bucket, cnt) of each task."""
    def run(batches):
        counts, word_counts = np.zeros(COUNTS, np.int64), np.zeros(WORD_COUNTS, np.int64)
        for batch in batches:
            fps, sizes, vectors = [], [], []
            for values, _ in _sets(batch, n, word_counts=word_counts):
                np.add.at(counts, (values >> U(47)).astype(np.int64), 1)
                fps.append(_fingerprint(values) if len(values) else None)
                sizes.append(len(values))
                vectors.append(_point(values) if len(values) else None)
            m = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), _bytes_column(vectors),
                 pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], ["id", "fp", "n", "point", "bucket", "cnt"])
        counts = np.concatenate([counts, word_counts])
        used = np.flatnonzero(counts)
        for at in range(0, len(used), 10_000):
            part = used[at:at + 10_000]
            m = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()),
                 pa.array(part.astype(np.int32)), pa.array(counts[part])], ["id", "fp", "n", "point", "bucket", "cnt"])

    return docs.mapInArrow(trimmed(run), POINTS)


ENTRIES = "h long, part int, hot boolean, fp long"


def entries(docs: DataFrame, n: int, rule: Rule, counts: np.ndarray) -> DataFrame:
    """(h, fp) for the first coordinates of each set, rare ones first; `part`
    deals out the cell of a frequent coordinate."""
    mean = int(counts[:COUNTS].sum()) // COUNTS
    limit = 4096 + 4 * mean
    # far above what chance makes of a table entry, in steps of that; below, what its words tell
    level = np.maximum(0, counts[:COUNTS] - mean) // (1 + 4 * int(mean ** 0.5))
    shared = docs.sparkSession.sparkContext.broadcast((level, 1 + counts[:COUNTS] // limit, np.log2(1.0 + counts[COUNTS:])))

    def run(batches):
        (levels, split, weight), seen = shared.value, set()
        for batch in batches:
            hs, ps, fps, lengths = [], [], [], []
            for values, often in _sets(batch, n, weight):
                if not len(values) or (fp := _fingerprint(values)) in seen:
                    continue
                seen.add(fp)
                entry = (values >> U(47)).astype(np.int64)
                rank = levels[entry] * 4096 + np.rint(often * 4).astype(np.int64)
                first = np.argsort(rank, kind="stable")[:rule.prefix(len(values))]
                hs.append(values[first])
                ps.append(split[entry[first]])
                fps.append(fp)
                lengths.append(len(first))
            if hs:
                owner = np.repeat(np.array(fps, np.int64), lengths)
                parts = np.concatenate(ps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hs).view(np.int64)),
                     pa.array((owner.view(U) % parts.astype(U)).astype(np.int32)),
                     pa.array(parts > 1), pa.array(owner)], ["h", "part", "hot", "fp"])

    return docs.mapInArrow(trimmed(run), ENTRIES)


MEMBERS = "h long, hot boolean, fp long, anchor long"


def members(dealt: DataFrame) -> DataFrame:
    """Cells of two points or more out of entries sorted by (h, part, fp): each
    point once, with the cell's smallest one as anchor. Parts of a frequent
    coordinate's cell come whole, as their points may meet in other parts."""
    def run(batches):
        last = None  # h, part, fp of the row before; anchor and hot of its cell; whether the anchor is out
        for batch in batches:
            h, part, hot, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(h):
                continue
            head = last or (h[0], part[0] - 1, fp[0], fp[0], False, True)
            new = np.append(head[0], h[:-1]) != h
            new |= np.append(head[1], part[:-1]) != part
            keep = new | (np.append(head[2], fp[:-1]) != fp)
            last_row = (h[-1], part[-1], fp[-1])
            h, hot, fp, new = h[keep], hot[keep], fp[keep], new[keep]
            if not len(h):
                last = (*last_row, *head[3:])
                continue
            cell = np.cumsum(new)  # 0: goes on from the batch before
            at = np.flatnonzero(new)
            anchors = np.append(head[3], fp[at])
            size = np.bincount(cell, minlength=len(anchors))
            out = (size >= 2)
            out[1:] |= hot[at]
            out[0] = size[0] > 0
            rows = out[cell]
            late = out[0] and not head[5]  # the anchor of the cell that goes on was held back
            cols = [h[rows], hot[rows], fp[rows], anchors[cell][rows]]
            if late:
                cols = [np.append(c, v) for c, v in zip(cols, (head[0], head[4], head[3], head[3]))]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(bool)),
                     pa.array(cols[2].astype(np.int64)), pa.array(cols[3].astype(np.int64))],
                    ["h", "hot", "fp", "anchor"])
            if len(at):
                last = (*last_row, anchors[-1], bool(hot[at[-1]]), bool(out[-1]))
            else:
                last = (*last_row, head[3], head[4], True)

    return dealt.mapInArrow(run, MEMBERS)


def _bounded(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs with points (a, na, pa, b, nb, pb) -> those whose summed minima
    reach the wanted overlap."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(at, PAIRS_AT_ONCE)
                na, nb = (part.column(i).to_numpy().astype(np.int64) for i in (1, 4))
                x, y = _vectors(part.column(2)), _vectors(part.column(5))
                shape = np.array([min(len(p), len(q)) for p, q in zip(x, y)])
                wide = np.array([max(len(p), len(q)) for p, q in zip(x, y)])
                keep = np.zeros(len(shape), bool)
                for g, h in set(zip(shape.tolist(), wide.tolist())):
                    rows = np.flatnonzero((shape == g) & (wide == h))
                    one, two = (np.stack([_folded(v[k][None], g)[0] for k in rows]) for v in (x, y))
                    keep[rows] = rule.enough(_minima(one, two), na[rows], nb[rows])
                keep = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(3).take(keep)], ["a", "b"])

    return pairs.mapInArrow(trimmed(run), "a long, b long")


class RTree:
    """Bulk-loaded R-tree over count vectors (sort-tile: by size, then by the
    coordinate that varies most within the tile). `pairs` joins two trees."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        tile = FANOUT * FANOUT
        for at in range(0, len(order) if len(order) > FANOUT else 0, tile):
            part = order[at:at + tile]
            axis = int(np.argmax(vectors[part].astype(np.float32).var(0)))
            order[at:at + tile] = part[np.argsort(vectors[part, axis], kind="stable")]
        self.order, sizes = order, sizes[order]
        self.levels = [(vectors[order], sizes, sizes)]
        while len(self.levels[-1][1]) > FANOUT:
            top, low, high = self.levels[-1]
            cuts = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts),
                                np.maximum.reduceat(high, cuts)))

    def _children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][1])))

    def pairs(self, other: RTree, rule: Rule):
        """Index pairs (of the given rows) whose bound reaches the wanted
        overlap, with the bound's share of both sizes."""
        la, lb = len(self.levels) - 1, len(other.levels) - 1
        stack = [(la, np.arange(len(self.levels[la][1])), lb, np.arange(len(other.levels[lb][1])))]
        while stack:
            la, left, lb, right = stack.pop()
            (va, lowa, higha), (vb, lowb, highb) = self.levels[la], other.levels[lb]
            fits = (100 * higha[left][:, None] >= rule.percent * lowb[right][None]) \
                & (100 * highb[right][None] >= rule.percent * lowa[left][:, None])
            i, j = np.nonzero(fits)
            bound = np.concatenate([np.zeros(0, np.int64)] + [
                _minima(va[left[i[at:at + 4096]]], vb[right[j[at:at + 4096]]]) for at in range(0, len(i), 4096)])
            least = rule.enough(bound, lowa[left[i]], lowb[right[j]])
            i, j, bound = left[i[least]], right[j[least]], bound[least]
            if la == 0 and lb == 0:
                yield self.order[i], other.order[j], bound / (lowa[i] + lowb[j])
            else:
                for p, q in zip(i.tolist(), j.tolist()):
                    stack.append((max(0, la - 1), self._children(la, p) if la else np.array([p]),
                                  max(0, lb - 1), other._children(lb, q) if lb else np.array([q])))


def _forest(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Indices of pairs that span what all pairs (of labels a and b) connect,
    for every part the pair of largest share first."""
    labels = np.unique(np.concatenate([a, b]))
    a, b = np.searchsorted(labels, a), np.searchsorted(labels, b)
    part, chosen = np.arange(len(labels)), []
    order = np.argsort(-share, kind="stable")
    while len(order := order[part[a[order]] != part[b[order]]]):
        ends = np.concatenate([part[a[order]], part[b[order]]])
        which = np.concatenate([np.arange(len(order))] * 2)
        rank = np.lexsort((which, ends))
        firsts = which[rank[np.flatnonzero(np.diff(ends[rank], prepend=-1))]]
        for k in order[np.unique(firsts)]:
            x, y = part[a[k]], part[b[k]]
            if x != y:
                part[part == max(x, y)] = min(x, y)
                chosen.append(k)
    return np.array(chosen, np.int64)


def _search(cells: DataFrame, rule: Rule, spanning: bool) -> DataFrame:
    """Rows (h, i, j, block, fp, c, n, point, hs) sorted by (h, i, j): the points
    of blocks i and j of cell h, c their component, hs the searched cells they
    are in. Pairs of points in different components that the trees of the two
    blocks leave, each out of the first cell that both are in, or as many of
    them (likeliest first) as would make one of what they connect."""
    def trees(rows: np.ndarray, vectors: list[np.ndarray], n: np.ndarray) -> dict[int, tuple]:
        """By their number of groups, and folded to half of it."""
        out = {}
        for g in {len(vectors[r]) for r in rows}:
            own = np.array([r for r in rows if len(vectors[r]) == g])
            full = np.stack([vectors[r] for r in own])
            out[g] = own, RTree(full, n[own]), RTree(_folded(full, g // 2), n[own]) if g > GROUPS else None
        return out

    def joined(h: int, i: int, j: int, rows: list) -> list:
        block, fp, c, n = (np.concatenate([r[k] for r in rows]) for k in range(4))
        vectors = [v for r in rows for v in r[4]]
        before = [hs[:np.searchsorted(hs, h)] for r in rows for hs in r[5]]
        low = block == i
        own = i == j
        if not own and (low.all() or not low.any()):  # the other block is empty
            return []
        one = trees(np.flatnonzero(low), vectors, n)
        two = one if own else trees(np.flatnonzero(~low), vectors, n)
        out = []
        for g, (ra, full, _) in one.items():  # linked sets differ by one step of the number of groups at most
            for k, x, y in ((g, full, 1), (2 * g, full, 2), (g // 2, one[g][2], 1)):
                if k not in two or (own and k < g) or x is None:
                    continue
                rb = two[k][0]
                for i, j, share in x.pairs(two[k][y], rule):
                    i, j = ra[i], rb[j]
                    keep = (c[i] != c[j]) & ((fp[i] < fp[j]) if own and k == g else True)
                    out.append((i[keep], j[keep], share[keep]))
        if not out:
            return out
        a, b, share = (np.concatenate(x) for x in zip(*out))
        first = _apart(before, a, b)
        a, b, share = a[first], b[first], share[first]
        if spanning and len(a):
            few = _forest(c[a], c[b], share)
            a, b = a[few], b[few]
        return [np.stack([np.full(len(a), h), np.minimum(fp[a], fp[b]), np.maximum(fp[a], fp[b])])]

    def pairs(found: list) -> pa.RecordBatch:
        h, a, b = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(a), pa.array(b)], ["h", "a", "b"])

    def run(batches):
        key, held, found = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            turns = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            rest = [batch.column(i).to_numpy().astype(np.int64) for i in range(3, 7)]
            vectors, lists = _vectors(batch.column(7)), _lists(batch.column(8))
            for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
                if hi == lo:
                    continue
                if key != (now := tuple(keys[:, lo].tolist())):
                    if held:
                        found += joined(*key, held)
                    key, held = now, []
                held.append([c[lo:hi] for c in rest] + [vectors[lo:hi], lists[lo:hi]])
            if sum(f.shape[1] for f in found) > 100_000:
                yield pairs(found)
                found = []
        if held:
            found += joined(*key, held)
        if found:
            yield pairs(found)

    return cells.mapInArrow(trimmed(run), "h long, a long, b long")


def _slots(ids: str):
    return F.pmod(F.xxhash64(ids), F.lit(SLOTS)).cast("int")


def _set_rows(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(fp, s) of the wanted classes (fp, id): the sets of the texts whose id
    may be wanted by a bit table of fixed size, so that other texts are neither
    hashed nor moved, then an exact semi-join on the fingerprint."""
    spark = texts.sparkSession
    bits = np.zeros(SLOTS // 64, np.int64)
    slot = _slots("id")
    words_set = wanted.select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("int").alias("word")) \
        .agg(F.expr("bit_or(shiftleft(1L, slot % 64)) AS bits"))
    for word, value in words_set.collect():  # SLOTS / 64 rows at most
        bits[word] = value
    shared = spark.sparkContext.broadcast(np.unpackbits(bits.view(np.uint8), bitorder="little"))

    def run(batches):
        table = shared.value
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(table[batch.column(2).to_numpy()])))
            for at in range(0, batch.num_rows, 256):
                fps, sets = [], []
                for values, _ in _sets(batch.slice(at, 256), n):
                    fps.append(_fingerprint(values) if len(values) else None)
                    sets.append(values.view(np.int64))
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fps, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["fp", "s"])

    found = texts.select("id", "text", slot.alias("slot")).mapInArrow(trimmed(run), "fp long, s array<long>")
    return found.join(wanted, "fp", "left_semi").dropDuplicates(["fp"])


def _tiles(cells: DataFrame, parts: DataFrame, small: DataFrame) -> DataFrame:
    """Cells of three points or more in several components, dealt out in pairs
    of blocks; one cell of those with the same points. A point's cells, which
    come with each of its rows, are `Rule.prefix` of its set's size at most."""
    label = parts.select(F.col("u").alias("fp"), F.col("v").alias("c"))
    placed = cells.select("h", "fp").join(label, "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    mixed = placed.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1"),
                                    F.sum(F.xxhash64("fp").cast("decimal(20,0)")).alias("same")) \
        .where("m > 2 and c0 <> c1").groupBy("m", "same").agg(F.min("h").alias("h")) \
        .select("h", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells_of = F.sort_array(F.collect_list("h").over(Window.partitionBy("fp"))).alias("hs")
    return placed.join(mixed, "h").select("h", "fp", "c", "blocks", cells_of).join(small, "fp") \
        .select("h", "fp", "c", block.alias("block"), other, "n", "point", "hs") \
        .select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "c",
                "n", "point", "hs") \
        .repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")


def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Number of shared values of each set of `one` with each of `two`."""
    n, m = len(one), len(two)
    out = np.zeros((n, m), np.int64)
    values, which = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    half = sum(map(len, one))
    sides = []
    for sets, of in ((one, which[:half]), (two, which[half:])):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(of, kind="stable")
        sides.append((row[order], np.bincount(of, minlength=len(values))))
    (rows, k), (cols, l) = sides
    at, to = np.cumsum(k) - k, np.cumsum(l) - l  # where a value's rows begin on each side
    often = k * l > DENSE
    dense = np.flatnonzero(often)
    for lo in range(0, len(dense), 1024):  # values that many pairs share: products of 0/1 tables
        part = dense[lo:lo + 1024]
        x, y = np.zeros((n, len(part)), np.float32), np.zeros((m, len(part)), np.float32)
        for j, v in enumerate(part):
            x[rows[at[v]:at[v] + k[v]], j] = 1
            y[cols[to[v]:to[v] + l[v]], j] = 1
        out += (x @ y.T).astype(np.int64)
    sparse = np.flatnonzero(~often & (k > 0) & (l > 0))
    ends = np.cumsum(k[sparse] * l[sparse])
    lo = 0
    while lo < len(sparse):  # all others: their pairs one by one
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
        v = sparse[lo:hi]
        size = k[v] * l[v]
        owner = np.repeat(v, size)
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        pair = rows[at[owner] + nth // l[owner]] * m + cols[to[owner] + nth % l[owner]]
        out += np.bincount(pair, minlength=n * m).reshape(n, m)
        lo = hi
    return out


def _apart(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sets of a pair (a, b) share nothing, for each pair."""
    if not len(a):
        return np.zeros(0, bool)
    left, i = np.unique(a, return_inverse=True)
    right, j = np.unique(b, return_inverse=True)
    return _overlaps([sets[k] for k in left], [sets[k] for k in right])[i, j] == 0


def _lists(column: pa.Array) -> list[np.ndarray]:
    at = column.offsets.to_numpy()
    data = column.values.to_numpy()
    return [data[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


def _counted(tiles: DataFrame, rule: Rule) -> DataFrame:
    """Rows (root, i, j, block, fp, copies, s) sorted by (root, i, j): the sets
    of blocks i and j of a component -> (fp, links), links being the rows of
    other sets of the tile that are linked with fp; a pair of sets of one block
    counts in its tile (i, i) only."""
    def linked(i: int, j: int, rows: list) -> pa.RecordBatch:
        block, fp, copies = (np.concatenate([r[k] for r in rows]) for k in range(3))
        sets = [s for r in rows for s in r[3]]
        own, low = i == j, block == i
        a, b = np.flatnonzero(low), np.flatnonzero(low if own else ~low)
        if not len(a) or not len(b):  # the other block is empty
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["fp", "links"])
        na, nb = (np.array([len(sets[r]) for r in side], np.int64) for side in (a, b))
        shared = _overlaps([sets[r] for r in a], [sets[r] for r in b])
        link = rule.enough(shared, na[:, None], nb[None]) & (shared > 0)
        if own:
            np.fill_diagonal(link, False)
            fp, count = fp[a], link @ copies[b]
        else:
            fp, count = np.concatenate([fp[a], fp[b]]), np.concatenate([link @ copies[b], copies[a] @ link])
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(count.astype(np.int64))], ["fp", "links"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            turns = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            rest = [batch.column(i).to_numpy().astype(np.int64) for i in range(3, 6)]
            sets = _lists(batch.column(6))
            for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
                if key != (now := tuple(keys[:, lo].tolist())):
                    if held:
                        yield linked(*key[1:], held)
                    key, held = now, []
                held.append([c[lo:hi] for c in rest] + [sets[lo:hi]])
        if held:
            yield linked(*key[1:], held)

    return tiles.mapInArrow(trimmed(run), "fp long, links long")


def _links(parts: DataFrame, sizes: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(fp, links) of every class of a component of two classes or more; `sizes`
    has (fp, n, copies) of all classes, `sets` the sets of those at least."""
    roots = parts.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct()
    placed = parts.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(roots).join(sizes, "fp")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = placed.groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1")  # a row for BLOCK classes at most
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = placed.join(F.broadcast(large), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) \
        .withColumn("block", block).join(sets, "fp") \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp",
                "copies", "s")
    return _counted(tiles.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"), rule) \
        .groupBy("fp").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                       percent: int = 75) -> DataFrame:
    """One row (id, n_shingles, component_id) per row of `docs`: the size of its
    n-gram set and the smallest id that it reaches over links, which two rows
    have when 100 * intersection >= percent * union of their sets."""
    return _joined(docs, id_col, text_col, n, percent, False)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                  percent: int = 75) -> DataFrame:
    """`jaccard_components`, and n_links: the number of other rows that a row
    is linked with, whether their sets are equal to its own or not."""
    return _joined(docs, id_col, text_col, n, percent, True)


def _joined(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, counted: bool) -> DataFrame:
    spark = configure(docs.sparkSession)
    rule, scratch = Rule(percent), Scratch(spark, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    first = scratch.write(points(texts, n), "points")
    table = first.where("bucket is not null").groupBy("bucket").agg(F.sum("cnt").alias("cnt"))
    counts = np.zeros(COUNTS + WORD_COUNTS, np.int64)
    for row in table.collect():  # as many rows at most
        counts[row[0]] = row[1]
    rows = first.where("bucket is null")
    classes = scratch.write(
        rows.where("fp is not null").groupBy("fp")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("point").alias("point"),
             F.count(F.lit(1)).alias("copies")), "classes")

    dealt = entries(texts, n, rule, counts).repartition("h", "part").sortWithinPartitions("h", "part", "fp")
    cells = scratch.write(members(dealt), "cells")
    tops = cells.where("hot").groupBy("h").agg(F.min("anchor").alias("top"))
    near = cells.select("anchor", "fp").unionByName(
        cells.where("hot").join(tops, "h").select(F.col("top").alias("anchor"), F.col("anchor").alias("fp")))
    near = near.where("anchor <> fp").distinct()
    small, sizes = classes.select("fp", "n", "point"), classes.select("fp", "n")
    fitting = near.join(sizes.toDF("anchor", "na"), "anchor").join(sizes, "fp") \
        .where(rule.sizes(F.col("na"), F.col("n"))).select("anchor", "fp")
    paired = fitting.join(small.toDF("anchor", "na", "pa"), "anchor").join(small, "fp") \
        .select("anchor", "na", "pa", F.col("fp").alias("b"), "n", "point")
    alike = scratch.write(_bounded(paired, rule), "alike")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        overlap = F.size(F.array_intersect("sa", "sb"))
        return both.where(rule.enough(overlap, F.size("sa"), F.size("sb"))) \
            .select(F.col("a").alias("u"), F.col("b").alias("v"))

    def ends(pairs: DataFrame) -> DataFrame:
        fps = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        return classes.select("fp", "id").join(fps, "fp", "left_semi")

    tested, sets = alike, scratch.write(_set_rows(texts, ends(alike), n), "sets-1")
    parts = components(scratch.write(verified(alike, sets), "links-1"), scratch, "parts-1")
    searched = cells
    for turn, spanning in ((2, True), (3, False)):  # what anchors didn't bring together: likely links, then all others
        found = scratch.write(_search(_tiles(searched, parts, small), rule, spanning), f"found-{turn}")
        fresh = scratch.write(found.select("a", "b").join(tested, ["a", "b"], "left_anti"), f"fresh-{turn}")
        late = _set_rows(texts, ends(fresh).join(sets, "fp", "left_anti"), n)
        sets = sets.unionByName(scratch.write(late, f"sets-{turn}"))
        links = scratch.write(verified(fresh, sets).unionByName(parts), f"links-{turn}")
        parts = components(links, scratch, f"parts-{turn}")
        tested = tested.unionByName(fresh)
        searched = cells.join(found.select("h").distinct(), "h", "left_semi")  # no other cell has a pair that is left

    named = classes.select("fp", "id").join(parts.toDF("fp", "root"), "fp", "left") \
        .select("fp", "id", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    owner = named.join(lowest, "root").select("fp", "component_id")
    columns = [F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
               F.coalesce("component_id", "id").alias("component_id")]
    if counted:
        links = scratch.write(_links(parts, classes.select("fp", "n", "copies"), sets, rule), "links")
        owner = owner.join(classes.select("fp", "copies"), "fp").join(links, "fp", "left") \
            .select("fp", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        columns.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    result = scratch.write(rows.select("id", "fp", "n").join(owner, "fp", "left").select(*columns), "result")
    scratch.keep_only("result")
    return result
