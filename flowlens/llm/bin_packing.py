"""Best-fit packing of documents into training sequences, with conflicts.

A document longer than the capacity is cut into whole sequences of its own and
a remainder. The remainders are packed best-fit decreasing: bins are kept in
order of their room, and the search starts at the bin that fits tightest and
goes on to the next larger room until one is compatible, or opens a new bin. A
bin takes no two documents of one source or of one duplicate cluster, and any
others: for each source and cluster that occurs twice or more in a shard, the
bins that hold it are listed, which is a bitmap over bins written as its set
bits, and exact for any number of values. Sources and clusters stand for their 64-bit
hashes. A row without a source or cluster conflicts with nothing on that account.

Lengths are ids of a tokenizer, the end of a text included, where its file is
given, and words between white space plus the end without one.

Remainders are dealt out by the hash of their id, length and cluster into shards
of about SHARD rows (rows equal in all three share a shard), so that every shard is a sample of all sources and lengths, however large
one source is; a shard is packed by one task and holds lengths, not texts. The
number of shards follows from the number of rows alone, so the result doesn't
depend on the cluster.

Defined results: null, empty and blank texts have one token, their end; ties go
by id, then source and cluster; repeated rows are packed each (and conflict by
their cluster); null ids are packed like others; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.text import groups, trimmed, utf8, words
from flowlens.llm.token_store import counts_of
from flowlens.session import Scratch, configure

CAPACITY = 4096
SHARD = 20_000
NO_BIN = 1 << 40
#: Bytes of text whose words are counted at a time (or one document, if longer).
GROUP = 1 << 20


class Holders:
    """Bins that hold each value, 0 and values that occur once left out."""

    def __init__(self, values: np.ndarray):
        known, of, counts = np.unique(values, return_inverse=True, return_counts=True)
        wanted = (counts > 1) & (known != 0)
        number = np.where(wanted, np.cumsum(wanted) - 1, -1)
        self.of = number[of].tolist()
        begin = np.cumsum(counts[wanted]) - counts[wanted]
        self.begin, self.end = begin.tolist(), begin.tolist()
        self.bins = np.zeros(int(counts[wanted].sum()), np.int64)

    def get(self, i: int) -> np.ndarray:
        """Bins with the value of item i."""
        k = self.of[i]
        return self.bins[self.begin[k]:self.end[k]] if k >= 0 else self.bins[:0]

    def add(self, i: int, b: int) -> None:
        if (k := self.of[i]) >= 0:
            self.bins[self.end[k]] = b
            self.end[k] += 1


def best_fit(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item, and its place in the bin, for items in descending
    order of length. Items with an equal value other than 0 in `sources` or
    `clusters` don't share a bin."""
    n = len(lengths)
    room, number = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # open bins in order of room, then of number
    held = Holders(np.asarray(sources)), Holders(np.asarray(clusters))
    barred = np.full(n + 1, -1, np.int64)  # the last item that a bin was barred for
    bins, places, used = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    opened = 0
    for i in range(n):
        size = lengths[i]
        at = int(np.searchsorted(room[:used], size, "left"))
        found = -1
        if at < used:
            for h in held:
                barred[h.get(i)] = i
        while at < used:  # the next larger rooms, some at a time
            to = min(used, at + 256)
            free = barred[number[at:to]] != i
            k = int(np.argmax(free))
            if free[k]:
                found = at + k
                break
            at = to
        if found < 0:
            left, b = capacity, opened
            opened += 1
        else:
            left, b = room[found], number[found]
            for x in (room, number):
                x[found:used - 1] = x[found + 1:used]
            used -= 1
        bins[i], places[i] = b, capacity - left
        for h in held:
            h.add(i, b)
        left -= size
        if left > 0:
            lo, hi = int(np.searchsorted(room[:used], left, "left")), int(np.searchsorted(room[:used], left, "right"))
            to = lo + int(np.searchsorted(number[lo:hi], b))
            for x, value in ((room, left), (number, b)):
                x[to + 1:used + 1] = x[to:used].copy()
                x[to] = value
            used += 1
    return bins, places


def _key(value: Column) -> Column:
    """A value's hash, 0 for none."""
    chosen = F.xxhash64(value)
    return F.when(value.isNull(), F.lit(0).cast("long")).when(chosen == 0, F.lit(1).cast("long")).otherwise(chosen)


def lengths(docs: DataFrame, id_col: str, text_col: str, source: Column, cluster: Column,
            tokenizer: str | None = None) -> DataFrame:
    """(id, n, source, cluster): ids of each text, or its words, and one end;
    hashes of the source and the duplicate cluster."""
    def run(batches):
        known = counts_of(tokenizer) if tokenizer else None
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            counts = [known.count(data, offsets[i:j + 1]) if known else
                      np.diff(words(data, offsets[i:j + 1]).first) + 1 for i, j in groups(offsets, GROUP)]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2), batch.column(3)],
                                             ["id", "n", "source", "cluster"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       _key(source).alias("source"), _key(cluster).alias("cluster"))
    return slim.mapInArrow(trimmed(run), "id long, n long, source long, cluster long")


def same_text(text_col: str) -> Column:
    """Duplicate cluster of texts that are equal but for the case of A-Z."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), upper, upper.lower()), 256)


PACKED = "shard int, id long, piece long, start long, n long, bin long, place long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: Column | None = None,
         cluster: Column | None = None, capacity: int = CAPACITY, shard: int = SHARD, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document: piece (number), piece_start and n_tokens
    (its tokens), bin_id and bin_start (where it lies). `tokenizer` is the file
    of a word tokenizer (see `token_store`), whose ids are counted."""
    spark = configure(docs.sparkSession)
    scratch = Scratch(spark, "packing")
    source = F.col("source") if source is None else source
    cluster = same_text(text_col) if cluster is None else cluster
    rows = scratch.write(lengths(docs, id_col, text_col, source, cluster, tokenizer), "lengths")
    shards = max(1, -(-rows.count() // shard))
    whole = (F.col("n") / capacity).cast("long")
    rows = rows.withColumn("whole", whole).withColumn("rest", F.col("n") - whole * capacity) \
        .withColumn("shard", F.pmod(F.xxhash64("id", "n", "cluster", F.lit(7)), F.lit(shards)).cast("int"))

    def run(batches):
        key, held = None, []
        for batch in batches:
            shard_of = batch.column(0).to_numpy()
            turns = (np.flatnonzero(np.diff(shard_of)) + 1).tolist()
            for lo, hi in zip([0, *turns], [*turns, len(shard_of)]):
                if hi == lo:
                    continue
                if key != shard_of[lo]:
                    if held:
                        yield packed(held)
                    key, held = shard_of[lo], []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        size, sources, clusters = (table.column(i).to_numpy() for i in (4, 5, 6))
        bins, places = best_fit(size, sources, clusters, capacity)
        one = table.to_batches()[0]
        return pa.RecordBatch.from_arrays([*(one.column(i) for i in range(5)), pa.array(bins), pa.array(places)],
                                          [c.split()[0] for c in PACKED.split(", ")])

    rest = rows.where("rest > 0").select("shard", "id", F.col("whole").alias("piece"), (F.col("whole") * capacity).alias("start"),
                                         F.col("rest").alias("n"), "source", "cluster")
    rest = rest.repartition(shards, "shard").sortWithinPartitions(
        "shard", F.desc("n"), F.asc_nulls_last("id"), "source", "cluster").mapInArrow(run, PACKED)
    full = rows.where("whole > 0").select("shard", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece")) \
        .select("shard", "id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n"),
                F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("place"))
    alone = F.concat_ws("-", F.lit("whole"), F.coalesce(F.col("id").cast("string"), F.lit("null")), "piece")
    shared = F.concat_ws("-", F.lit("shard"), "shard", "bin")
    out = rest.unionByName(full).select(
        F.col("id").alias(id_col), "piece", F.col("start").alias("piece_start"), F.col("n").alias("n_tokens"),
        F.when(F.col("bin").isNull(), alone).otherwise(shared).alias("bin_id"), F.col("place").alias("bin_start"))
    out = scratch.write(out, "result")
    scratch.keep_only("result")
    return out
