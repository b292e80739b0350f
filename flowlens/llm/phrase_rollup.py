"""Phrase collocations by top-order marginalisation.

Texts are cut into pieces at punctuation and line ends and those into words.
At every word one window is taken, the word and the next three of its piece as
columns w1..w4, padded with '' behind the piece's end. Only these longest
windows are counted. A phrase of k words begins at exactly one window for each
of its occurrences, so ROLLUP (lang, w1, w2, w3, w4) gives the counts of all
shorter phrases as sums over the windows that they begin; no n-grams of other
lengths are ever made.

Before that, windows lose what can't matter: all parts of a phrase with a count
of `least` have such counts, too. A first pass over the texts counts words and
neighbouring pairs by their hashes, a second one the phrases of three and four
words whose pairs passed, each in a table of 2^TABLE_BITS counters for a task,
which Spark sums; a window ends before a phrase, and none begins at a word,
whose counter stays under `least`. A counter never is below the count of any of
its phrases, so none is lost and no count that is looked at later changes. The
tables have the same size for every input: they save the more the smaller the
input is to them, and decide no result.

A candidate's cuts look up the counts of both parts by one join (parts of one
word, the only ones that very many candidates share, over SALTS copies), longer
phrases hand their counts to the shorter ones inside them as a partial maximum,
and the best of each lang are taken by a ranked window whose limit Spark
applies before its shuffle.

Defined results: a null text is empty, a null lang is `und`; rows are counted
however often they or their ids repeat; an empty table, or one without frequent
phrases, gives no rows; other columns are not looked at; a piece of any length
is read in windows of bounded size.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.text import U, groups, mix, utf8, words
from flowlens.session import Scratch, configure

ORDER = 4
NO_LANG = "und"
TABLE_BITS = 26
#: Counters in one row of a table.
BLOCK = 1 << 15
SALTS = 16

_GAP = b" \t"
_BREAK = b".,;:!?\n\x0b\x0c\r"
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(_GAP + _BREAK)] = False
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(_BREAK)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_LEAD = mix(np.arange(1, ORDER + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)

WINDOW = ", ".join(f"w{k} string" for k in range(1, ORDER + 1))
COUNTERS = "block int, lang string, n long, counts binary"
_COUNTERS = (pa.int32(), pa.string(), pa.int64(), pa.binary())


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Bytes and offsets of a few documents at a time, a hash of each one's
    lang, and the langs."""
    data, offsets = utf8(batch.column("text"))
    langs = batch.column("lang").dictionary_encode()
    code = langs.indices.to_numpy(zero_copy_only=False)
    hashed = mix(np.array([zlib.crc32(x.encode()) + (len(x) << 32) for x in langs.dictionary.to_pylist()], U))
    for i, j in groups(offsets):
        yield data, offsets[i:j + 1], hashed[code[i:j]], batch.column("lang")[i:j]


def _lead(x: np.ndarray, k: int, pad=0) -> np.ndarray:
    """The value k places on, `pad` behind the end."""
    out = np.full(len(x), pad, x.dtype)
    out[:max(0, len(x) - k)] = x[k:]
    return out


def _marked(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the bits at `place` are set in a packed table."""
    return (table[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


class _Pieces:
    """Words of some documents, which neighbours share a piece, and the table
    places of the phrases that begin at each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, bits: int):
        self.words = w = words(data, offsets, in_word=_IN_WORD)
        n = len(w.hash)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
        lo, hi = int(offsets[0]), int(offsets[-1])
        breaks = np.flatnonzero(_IS_BREAK[data[lo:hi]]) + lo
        before = np.searchsorted(breaks, w.start)
        joined = np.zeros(n, bool)
        joined[:-1] = (before[1:] == before[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.lang, self.shift = lang[self.doc], U(64 - bits)
        #: whether a phrase of k + 1 words fits the piece
        self.fits = [np.ones(n, bool), joined]
        for k in range(2, ORDER):
            self.fits.append(self.fits[-1] & _lead(joined, k - 1, False))

    def key(self, size: int) -> np.ndarray:
        key = self.lang + U(size)
        for k in range(size):
            key = key + _lead(self.words.hash, k) * _LEAD[k]
        return key

    def place(self, size: int) -> np.ndarray:
        return (mix(self.key(size)) >> self.shift).astype(np.int64)

    def often(self, tables: list[np.ndarray]) -> list[np.ndarray]:
        """For 1, 2 words and, with both tables, 3 and 4 words: whether the
        phrase's counter and those of its parts reach the threshold."""
        has = []
        for size in range(1, 2 * len(tables) + 1):
            parts = self.fits[size - 1].copy()
            if has:
                parts &= has[-1] & _lead(has[-1], 1, False)
            at = np.flatnonzero(parts)
            parts[at] = _marked(tables[(size - 1) // 2], self.place(size)[at])
            has.append(parts)
        return has


def count_places(batches: Iterator[pa.RecordBatch], bits: int, tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The table of this task in compressed blocks: of words and pairs, with the
    words of each lang, or after those, of the phrases of three and four words."""
    table = np.zeros(1 << bits, np.uint8)
    total: dict[str, int] = {}
    for batch in batches:
        for data, offsets, lang, names in _texts(batch):
            p = _Pieces(data, offsets, lang, bits)
            if tables:
                pair = p.often(tables)[1]
                three = pair & _lead(pair, 1, False)
                which = [(3, three), (4, three & _lead(pair, 2, False))]
            else:
                which = [(1, p.fits[0]), (2, p.fits[1])]
                for name, n in zip(names.to_pylist(), np.diff(p.words.first).tolist()):
                    total[name] = total.get(name, 0) + n
            at, n = np.unique(np.concatenate([p.place(size)[ok] for size, ok in which]), return_counts=True)
            table[at] = np.minimum(table[at] + n, 255)
    blocks = table.reshape(-1, min(BLOCK, len(table)))
    used = np.flatnonzero(blocks.any(axis=1)).tolist()
    def rows() -> Iterator[tuple]:
        yield from ((-1, k, n, None) for k, n in total.items())
        for block in used:
            yield block, None, None, pa.compress(blocks[block].tobytes(), "zstd", asbytes=True)

    left = rows()
    while part := list(itertools.islice(left, 64)):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), _COUNTERS)],
                                         ["block", "lang", "n", "counts"])


def sum_blocks(batches: Iterator[pa.RecordBatch], least: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by block -> for each block a bit for each counter that
    reaches `least` in sum; rows of langs pass."""
    now, total = None, np.zeros(size, np.uint16)

    def done() -> Iterator[pa.RecordBatch]:
        if now is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([None], pa.string()), pa.array([None], pa.int64()),
                 pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["block", "lang", "n", "often"])

    for batch in batches:
        langs = batch.filter(pa.compute.less(batch.column("block"), 0))
        if len(langs):
            yield langs.rename_columns(["block", "lang", "n", "often"])
        blocks = batch.slice(len(langs))  # they follow, in order
        for block, counts in zip(blocks.column("block").to_pylist(), blocks.column("counts")):
            if block != now:
                yield from done()
                now, total = block, np.zeros(size, np.uint16)
            raw = pa.decompress(counts.as_buffer(), decompressed_size=size, codec="zstd")
            total = np.minimum(total + np.frombuffer(raw, np.uint8), 255)
    yield from done()


def count_windows(batches: Iterator[pa.RecordBatch], bits: int, tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Distinct windows of a few documents at a time, with their counts."""
    for batch in batches:
        for data, offsets, lang, names in _texts(batch):
            p = _Pieces(data, offsets, lang, bits)
            w, n = p.words, len(p.words.hash)
            has = p.often(tables)
            at = np.flatnonzero(has[0])
            if len(at) == 0:
                continue
            key = p.key(1)
            for k in range(1, ORDER):
                key = key + np.where(has[k], _lead(w.hash, k), U(0)) * _LEAD[k]
            _, one, count = np.unique(mix(key[at]), return_index=True, return_counts=True)
            at = at[one]
            lo, hi = int(offsets[0]), int(offsets[-1])
            text = _FOLD[data[lo:hi][_IN_WORD[data[lo:hi]]]]
            ends = np.zeros(n + 2, np.int32)
            np.cumsum(w.end - w.start, out=ends[1:-1])
            ends[-1] = ends[-2]  # the last string is the padding
            strings = pa.StringArray.from_buffers(n + 1, pa.py_buffer(ends), pa.py_buffer(text))
            columns = [names.take(pa.array(p.doc[at]))]
            columns += [strings.take(pa.array(np.where(has[k][at], at + k, n))) for k in range(ORDER)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count)],
                                             ["lang", *(f"w{k}" for k in range(1, ORDER + 1)), "n"])


def phrase_counts(docs: DataFrame, scratch: Scratch, least: int = 30, bits: int = TABLE_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, size, f) of all phrases of up to four words with a count of
    `least` at least, and (lang, n), the number of words of each lang.
    `docs` has lang and text; `least` is 255 at most for the table's sake."""
    spark = docs.sparkSession
    size, packed = min(BLOCK, 1 << bits), []

    def values() -> list[np.ndarray]:
        return [np.frombuffer(t.value, np.uint8) for t in packed]

    def places(batches):
        yield from count_places(batches, bits, values())

    def windows(batches):
        yield from count_windows(batches, bits, values())

    for turn in ("pairs", "longer"):
        dealt = docs.mapInArrow(places, COUNTERS).repartition("block").sortWithinPartitions("block")
        summed = scratch.write(dealt.mapInArrow(lambda b: sum_blocks(b, min(least, 255), size),
                                                "block int, lang string, n long, often binary"), turn)
        table = np.zeros((1 << bits) // 8, np.uint8)
        for row in summed.where("block >= 0").toLocalIterator():  # 2^bits bits at every size of the input
            table[row.block * size // 8:(row.block + 1) * size // 8] = np.frombuffer(row.often, np.uint8)
        packed.append(spark.sparkContext.broadcast(table.tobytes()))
    total = spark.read.parquet(scratch.path("pairs")).where("block < 0").groupBy("lang").agg(F.sum("n").alias("n"))

    names = [f"w{k}" for k in range(1, ORDER + 1)]
    longest = docs.mapInArrow(windows, f"lang string, {WINDOW}, n long") \
        .groupBy("lang", *names).agg(F.sum("n").alias("n"))
    summed = longest.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # bits of the columns that are summed over: none for four words, w4 for three, ...
    used = F.lit(ORDER) - F.length(F.regexp_replace(F.bin("level"), "0", ""))
    phrases = summed.where((F.col("f") >= least) & (F.col("level") < (1 << ORDER) - 1)) \
        .select("lang", F.slice(F.array(*names), F.lit(1), used.cast("int")).alias("words"), "f") \
        .where(F.element_at("words", -1) != "") \
        .withColumn("size", F.size("words"))
    return scratch.write(phrases, "phrases"), total


def _joined(words) -> F.Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000,
                 scale: int = 2_000_000, inside: int = 80, bits: int = TABLE_BITS) -> DataFrame:
    """The `top` phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to 4 words with a count a of `least` score floor(scale * a / (l + r)),
    l and r the counts of both sides of the cut with the lowest score (ties: the
    earliest). One that a longer such phrase holds, with `inside` percent of its
    count or more, is left out."""
    spark = configure(docs.sparkSession)
    scratch = Scratch(spark, "phrases")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    phrases, total = phrase_counts(rows, scratch, least, bits)

    longer = phrases.where("size > 2") \
        .select("lang", "f", F.explode(F.expr("""flatten(transform(sequence(2, size - 1), k ->
            transform(sequence(1, size - k + 1), i -> array_join(slice(words, i, k), ' '))))""")).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("f").alias("outer_f"))
    candidates = phrases.where("size > 1").withColumn("phrase", _joined("words")) \
        .join(longer, ["lang", "phrase"], "left") \
        .where(F.col("outer_f").isNull()
               | (F.col("outer_f").cast("decimal(38,0)") * 100 < F.col("f").cast("decimal(38,0)") * inside))

    parts = candidates.select(
        "lang", "phrase", F.col("f").alias("a"), F.explode(F.expr("""flatten(transform(sequence(1, size - 1), k -> array(
            struct(k AS cut, true AS head, slice(words, 1, k) AS words),
            struct(k AS cut, false AS head, slice(words, k + 1, size - k) AS words))))""")).alias("part")) \
        .select("lang", "phrase", "a", "part.cut", "part.head", _joined("part.words").alias("part"),
                F.when(F.size("part.words") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
                .otherwise(0).alias("salt"))
    counts = phrases.where(f"size < {ORDER}") \
        .select("lang", _joined("words").alias("part"), F.col("f").alias("part_f"),
                F.explode(F.sequence(F.lit(0), F.when(F.col("size") == 1, SALTS - 1).otherwise(0))).alias("salt"))
    cuts = parts.join(counts, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "cut") \
        .agg(F.max(F.when(F.col("head"), F.col("part_f"))).alias("l"),
             F.max(F.when(~F.col("head"), F.col("part_f"))).alias("r"))
    # integral division of decimals is exact, and its quotient below scale / 2
    score = F.expr(f"(cast(a as decimal(28,0)) * {scale}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a") \
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    out = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score") \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .join(total, "lang") \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = scratch.write(out, "result")  # at most `top` rows a lang
    scratch.keep_only("result")
    return out
