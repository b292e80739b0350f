"""Spelling variants by a dictionary of pairs of trie nodes.

The forward trie holds the words, the reversed trie the words read from their
ends: a prefix is a node of the one, a suffix a node of the other. A node that
only one word passes can't be shared, so only the nodes of two words or more
are numbered; the empty prefix and the empty suffix are node 0. Then a word is
described by pairs of integers:

* skip pairs (node before a letter, node behind it), one for each letter,
* split pairs (node before a place, node behind it), one for each place.

Two words of equal skip pairs differ in that letter alone (a replacement); a
word whose skip pair is another word's split pair has one letter more (an
insertion, a deletion). These joins give every word at a distance of one and no
other. Where a letter is repeated only its last copy is skipped for the second
join, so no pair of words is found twice.

Prefixes and suffixes are keyed by two 64-bit hashes of their letters while the
nodes are counted and numbered, so that a word costs rows in proportion to its
length. A skip pair is shared by as many words as there are letters at the
most, a split pair by one; the nodes near the roots, which very many words
pass, are joined as a table bounded by the letters there are.

The words themselves: runs of letters are found in the bytes of a few documents
at a time, their CRC-32 goes on from that of the document's id, table-driven
over all runs at once, distinct words are counted there and Spark sums them.

Defined results: a null text has no words; a null id counts as the empty
string; rows are counted however often they or their ids repeat; an empty table
gives no rows; other columns are not looked at; words of any length are whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.text import U, groups, mix, utf8
from flowlens.session import Scratch, configure

#: A run loses a letter where this divides its checksum.
EDIT = 199
#: Nodes of this depth or less are at most (number of letters)^ROOTS + ... many.
ROOTS = 2
#: How often forms are followed: a form's count is at least five times the
#: word's, so no chain of 64-bit counts is longer than 2^5.
DOUBLINGS = 5
CHUNK = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LEAD = 0xC3  # of U+00C0 to U+00FF, each two bytes
_BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_MARKS = tuple(mix(np.arange(1 << 16, dtype=U) * b + b) for b in _BASES)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc_from(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, each going on from the checksum of what precedes it."""
    order = np.argsort(start - end, kind="stable")  # longest first
    size = (end - start)[order]
    at, c = start[order], ~state[order].astype(np.uint32)
    live = len(at)
    for k in range(int(size[0]) if live else 0):
        live = int(np.searchsorted(-size, -k, "left"))  # ranges longer than k
        c[:live] = _CRC[(c[:live] ^ data[at[:live] + k]) & 255] ^ (c[:live] >> 8)
    out = np.empty(len(at), np.uint32)
    out[order] = ~c
    return out


def _runs(b: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and code points of the runs of letters in lower-cased bytes;
    documents begin at `inner`."""
    lead = b == _LEAD
    tail = np.zeros(len(b), bool)
    tail[1:] = lead[:-1]
    is_letter = _LETTER[b] | lead | tail
    opens, closes = is_letter.copy(), is_letter.copy()
    opens[1:] &= ~is_letter[:-1]
    closes[:-1] &= ~is_letter[1:]
    inner = inner[(inner > 0) & (inner < len(b))]
    opens[inner] = is_letter[inner]
    closes[inner - 1] = is_letter[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    tails = np.zeros(len(b) + 1, np.int64)
    np.cumsum(tail, out=tails[1:])
    return start, end, end - start - (tails[end] - tails[start])


def _keys(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, by sums of powers."""
    power = np.full(len(b) + 1, _BASES[0], U)
    power[0] = 1
    power = np.cumprod(power, dtype=U)
    total = np.zeros(len(b) + 1, U)
    np.cumsum(_MARKS[0][b] * power[:len(b)], out=total[1:])
    return mix((total[end] - total[start]) * power[len(b) - start] + (end - start).astype(U))


def count_words(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Words of `least` code points or more with their counts, distinct within
    a few documents each."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids = batch.column("id").to_pylist()
        for i, j in groups(offsets):
            lo, hi = int(offsets[i]), int(offsets[j])
            if lo == hi:
                continue
            b = _FOLD[data[lo:hi]]
            edges = offsets[i:j + 1] - lo
            start, end, size = _runs(b, edges[:-1])
            long = size >= least
            start, end, size = start[long], end[long], size[long]
            if len(start) == 0:
                continue
            doc = np.searchsorted(edges, start, "right") - 1
            state = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in ids[i:j]], np.uint32)
            crc = crc_from(state[doc], b, start, end)
            edited = crc % EDIT == 0
            words, counts = [], []
            for s, e, h in zip(start[edited].tolist(), end[edited].tolist(), crc[edited].tolist()):
                word = b[s:e].tobytes().decode()
                at = h % len(word)
                if len(word) > least:
                    words.append(word[:at] + word[at + 1:])
                    counts.append(1)
            start, end = start[~edited], end[~edited]
            _, one, n = np.unique(_keys(b, start, end), return_index=True, return_counts=True)
            words += [b[s:e].tobytes().decode() for s, e in zip(start[one].tolist(), end[one].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(np.concatenate((np.array(counts, np.int64), n.astype(np.int64))))],
                ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_size: int = 6,
               least_n: int = 5) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda b: count_words(b, least_size), "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


NODES = "id long, place int, head long, head2 long, tail long, tail2 long, last boolean"


def trie_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every place 0..length of a word the keys of the prefix before and of
    the suffix behind it, and whether the letter before the place is the last of
    a run of equal ones (false at place 0)."""
    def emit(part):
        ids, places, heads, tails, last = (np.concatenate(x) for x in zip(*part))
        signed = [x.view(np.int64) for x in (heads[:, 0], heads[:, 1], tails[:, 0], tails[:, 1])]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(places), *(pa.array(np.ascontiguousarray(x)) for x in signed), pa.array(last)],
            ["id", "place", "head", "head2", "tail", "tail2", "last"])

    part, used = [], 0
    for batch in batches:
        for k, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
            c = np.frombuffer(word.encode("utf-16-le"), np.uint16)  # letters up to U+00FF
            n = len(c)
            heads, tails = np.zeros((n + 1, 2), U), np.zeros((n + 1, 2), U)
            for x, (base, marks) in enumerate(zip(_BASES, _MARKS)):
                power = np.full(n + 1, base, U)
                power[0] = 1
                power = np.cumprod(power, dtype=U)
                m = marks[c]
                heads[1:, x] = np.cumsum(m * power[:n], dtype=U)
                tails[1:, x] = np.cumsum(m[::-1] * power[:n], dtype=U)
            place = np.arange(n + 1)
            size = place.astype(U) * _BASES[1]
            heads, tails = mix(heads + size[:, None]), mix(tails + size[:, None])
            last = np.ones(n + 1, bool)
            last[0] = False
            last[1:n] = c[:-1] != c[1:]
            part.append((np.full(n + 1, k), place.astype(np.int32), heads, tails[::-1], last))
            used += n + 1
            if used >= CHUNK:
                yield emit(part)
                part, used = [], 0
    if part:
        yield emit(part)


def _numbered(keys: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """(depth, key, key2) of trie nodes, one row a word -> the shared nodes with a number."""
    shared = keys.where("depth > 0").groupBy("depth", "key", "key2").agg(F.count(F.lit(1)).alias("words")).where("words > 1")
    return scratch.write(shared.select("depth", "key", "key2", (F.monotonically_increasing_id() + 1).alias("node")), name)


def _with_nodes(keys: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """id, place and number of the shared nodes that each word passes."""
    low, high = nodes.where(F.col("depth") <= ROOTS), nodes.where(F.col("depth") > ROOTS)
    at = ["depth", "key", "key2"]
    top = keys.where((F.col("depth") > 0) & (F.col("depth") <= ROOTS)).join(F.broadcast(low), at)  # bounded by the letters
    rest = keys.where(F.col("depth") > ROOTS).join(high, at)
    root = keys.where("depth = 0").withColumn("node", F.lit(0).cast("long"))
    return top.unionByName(rest).unionByName(root, allowMissingColumns=True).select("id", "place", F.col("node").alias(name))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, word, n) with unique ids -> (id, near), both ways, of the words that
    differ by one inserted, deleted or replaced code point."""
    keys = scratch.write(words.select("id", "word").mapInArrow(trie_keys, NODES), "keys")
    length = F.max("place").alias("length")
    lengths = keys.groupBy("id").agg(length)
    heads = keys.select("id", "place", F.col("place").alias("depth"), F.col("head").alias("key"), F.col("head2").alias("key2"))
    tails = keys.join(lengths, "id").select("id", "place", (F.col("length") - F.col("place")).alias("depth"),
                                            F.col("tail").alias("key"), F.col("tail2").alias("key2"))
    forward, backward = _numbered(heads, "forward", scratch), _numbered(tails, "backward", scratch)
    places = _with_nodes(heads, forward, "head").join(
        _with_nodes(tails, backward, "tail"), ["id", "place"], "full").join(keys.select("id", "place", "last"), ["id", "place"])
    places = scratch.write(places, "places")
    scratch.drop("keys", "forward", "backward")
    split = places.where("head is not null and tail is not null").select(F.col("id").alias("split_id"), "head", "tail")
    # the letter between place - 1 and place is skipped
    before = places.where("head is not null").select("id", (F.col("place") + 1).alias("place"), "head")
    skip = scratch.write(before.join(places.where("tail is not null").select("id", "place", "tail", "last"), ["id", "place"])
                         .select("id", "head", "tail", "last"), "skip")
    replaced = skip.alias("a").join(skip.alias("b"), ["head", "tail"]).where("a.id <> b.id") \
        .select(F.col("a.id").alias("id"), F.col("b.id").alias("near"))
    longer = scratch.write(skip.where("last").join(split, ["head", "tail"])
                           .select("id", F.col("split_id").alias("near")), "longer")
    return replaced.unionByName(longer).unionByName(longer.select(F.col("near").alias("id"), F.col("id").alias("near")))


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_size: int = 6,
                   least_n: int = 5, times: int = 5) -> DataFrame:
    """One row a word: word, n, n_near, form (the near word of the largest n,
    ties to the smallest in code points, where that is `times` the word's),
    form_n, root (the end of the forms)."""
    spark = configure(docs.sparkSession)
    scratch = Scratch(spark, "trie-pairs")
    # ids in the words' order: ranges follow each other, and UTF-8 sorts as code points
    counted = scratch.write(vocabulary(docs, id_col, text_col, least_size, least_n), "counted")
    words = scratch.write(counted.repartitionByRange("word").sortWithinPartitions("word")
                          .select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = near_words(words, scratch)
    counts = words.select(F.col("id").alias("near"), F.col("n").alias("near_n"))
    best = near.join(counts, "near").groupBy("id").agg(
        F.count(F.lit(1)).alias("n_near"), F.max(F.struct("near_n", (-F.col("near")).alias("order"))).alias("best"))
    known = scratch.write(
        words.join(best, "id", "left")
        .select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(F.col("best.near_n") >= F.lit(times) * F.col("n"), F.struct(
                    (-F.col("best.order")).alias("id"), F.col("best.near_n").alias("n"))).alias("form")), "known")
    root = scratch.write(known.where("form is not null").select("id", F.col("form.id").alias("to")), "root-0")
    for k in range(1, DOUBLINGS + 1):
        onward = root.select(F.col("id").alias("to"), F.col("to").alias("next"))
        root = scratch.write(root.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to")), f"root-{k}")
        scratch.drop(f"root-{k - 1}")
    names = words.select(F.col("id").alias("to"), F.col("word").alias("root"))
    forms = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    out = known.select("id", "word", "n", "n_near", F.col("form.id").alias("form_id"), F.col("form.n").alias("form_n")) \
        .join(root.join(names, "to").select("id", "root"), "id", "left").join(forms, "form_id", "left") \
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = scratch.write(out, "result")
    scratch.keep_only("result")
    return out
