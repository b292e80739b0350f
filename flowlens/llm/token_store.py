"""Token ids in Parquet list columns.

Layout of a store: one row per document in ascending id order, over files that
are ranges of the ids; columns doc_id, n_tokens and ids (list<int32>), all of
them dictionary-encoded by Parquet with zstd pages; row groups of ROW_GROUP
bytes and pages of PAGE_ROWS rows at most, with Parquet's column and offset
index, so that a reader of a few documents, or of n_tokens alone, reads few
pages.

Texts are dealt out by ranges of their ids before they are encoded (a text
takes less room than its ids), sorted, encoded word by word, and written by
Spark's Parquet writer. The tokenizer drops white space and splits at it, so a
text's ids are those of its words in order; a worker encodes a word once and
keeps its ids, by the word's 64-bit hash, for up to CACHE words.

Defined results: a null text is empty and has the end id alone; rows with the
same id follow each other, ordered by their texts; null ids come first; an
empty table gives an empty store; other columns are not looked at.
"""

from __future__ import annotations

import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.text import U, Words, groups, utf8, words
from flowlens.session import configure

END_ID = 2
#: Words that a worker keeps encoded.
CACHE = 3_000_000
#: Words whose ids are held at a time to count them.
AT_ONCE = 20_000
MARKS = ",.!?;:"
ROW_GROUP = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 512
OPTIONS = {
    "compression": "zstd", "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20), "parquet.writer.version": "PARQUET_2_0",
}

_caches: dict[tuple[type, str], WordIds] = {}


def _of_letters(word: str) -> bool:
    """Whether the tokenizer, too, sees nothing but letters."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordIds:
    """Ids of the words met so far, by the words' hashes (A-Z folded, as the
    tokenizer does): sorted keys, and places in one pool of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of words. Those of letters alone are encoded in one text, whose
        ids part where a word's last symbol ends."""
        out: list = [None] * len(texts)
        letters = [i for i, t in enumerate(texts) if _of_letters(t)]
        whole, = self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in letters)], add_special_tokens=False)
        ids = np.array(whole.ids, np.int32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(letters):
            for i, part in zip(letters, np.split(ids, stops[:-1])):
                out[i] = part
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(found.ids, np.int32)
        return out

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of words; a mark after letters is encoded apart, as it is a token
        of its own."""
        stems: dict[str, int] = {}
        parts = []
        for t in texts:
            marked = t[-1] in MARKS and _of_letters(t[:-1])
            parts.append((stems.setdefault(t[:-1] if marked else t, len(stems)),
                          stems.setdefault(t[-1], len(stems)) if marked else None))
        plain, found = list(stems), []
        for at in range(0, len(plain), 5_000):
            found += self._encoded(plain[at:at + 5_000])
        return [found[a] if b is None else np.concatenate([found[a], found[b]]) for a, b in parts]

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Add words."""
        ids = self._ids(texts)
        size = np.array(list(map(len, ids)), np.int64)
        total = int(size.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        self.pool[self.used:self.used + total] = np.concatenate(ids)
        at = self.used + np.cumsum(size) - size
        self.used += total
        place = np.searchsorted(self.keys, hashes)
        self.keys, self.at, self.size = (np.insert(x, place, y) for x, y in
                                         ((self.keys, hashes), (self.at, at), (self.size, size)))

    def _places(self, data: np.ndarray, w: Words) -> np.ndarray:
        """Place of each word among those kept, where new ones are added."""
        keys, first, word = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        if new.any():
            if len(self.keys) + int(new.sum()) > CACHE:
                self.forget()
                new[:] = True
            texts = [data[a:b].tobytes().decode() for a, b in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist())]
            self._learn(keys[new], texts)
            place = np.searchsorted(self.keys, keys)
        return place[word]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts at `offsets`, each with the end id, and their offsets."""
        w = words(data, offsets)
        place = self._places(data, w)
        at, size = self.at[place], self.size[place]
        ends = np.cumsum(np.append(0, size))
        stops = ends[w.first]
        take = np.repeat(at - ends[:-1], size) + np.arange(int(ends[-1]))
        ids = np.insert(self.pool[take], stops[1:], end_id)
        return ids, stops + np.arange(len(stops))


class WordCounts(WordIds):
    """Only the numbers of ids of the words met so far: 12 bytes a word."""

    def forget(self) -> None:
        self.keys, self.size = np.zeros(0, U), np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        size = np.zeros(len(texts), np.int32)
        for at in range(0, len(texts), AT_ONCE):
            size[at:at + AT_ONCE] = list(map(len, self._ids(texts[at:at + AT_ONCE])))
        place = np.searchsorted(self.keys, hashes)
        self.keys, self.size = np.insert(self.keys, place, hashes), np.insert(self.size, place, size)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text at `offsets`, its end included."""
        w = words(data, offsets)
        place = self._places(data, w)
        ends = np.cumsum(np.append(0, self.size[place]))
        return np.diff(ends[w.first]) + 1


def _kept(kind: type, path: str):
    if (kind, path) not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _caches[kind, path] = kind(path)
    return _caches[kind, path]


def ids_of(path: str) -> WordIds:
    return _kept(WordIds, path)


def counts_of(path: str) -> WordCounts:
    return _kept(WordCounts, path)


STORE = "doc_id long, n_tokens long, ids array<int>"


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                end_id: int = END_ID) -> None:
    """Encode `text_col` and write the store to `path`."""
    configure(docs.sparkSession)

    def run(batches):
        known = ids_of(tokenizer)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in groups(offsets):
                ids, at = known.encode(data, offsets[i:j + 1], end_id)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), lists],
                                                 ["doc_id", "n_tokens", "ids"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = slim.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    ranged.sortWithinPartitions("doc_id", "text").mapInArrow(run, STORE).write.options(**OPTIONS).parquet(path)


def read_store(spark, path: str, columns: str = STORE) -> DataFrame:
    return spark.read.schema(columns).parquet(path)


def starts(store: DataFrame) -> DataFrame:
    """(file, row, start): tokens of the store before each row, from the counts
    alone. A file's rows are added up in the file, and the few files in order
    of their part numbers, which follow the ranges of ids."""
    place = store.select("n_tokens", "doc_id", F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.row_index").alias("row"))
    # from the sixth digit on, numbers don't sort as text
    part = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")
    files = place.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = files.select("file", F.coalesce(
        F.sum("total").over(Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(
        Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return place.select("file", "row", "doc_id", "n_tokens", inside.alias("inside")).join(F.broadcast(before), "file") \
        .select("file", "row", "doc_id", "n_tokens", (F.col("before") + F.col("inside")).alias("start"))


def _checksums(store: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = lists.offsets.to_numpy().tolist()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64())],
                                             ["file", "row", "ids_crc32"])

    named = store.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "ids")
    return named.mapInArrow(run, "file string, row long, ids_crc32 long")


def store_index(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    crc = _checksums(read_store(spark, path))
    return starts(read_store(spark, path)).join(crc, ["file", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def select_documents(spark, path: str, condition: Column) -> DataFrame:
    """Documents by a condition on doc_id or n_tokens, which Parquet's indexes
    turn into the pages to read."""
    return read_store(spark, path).where(condition)
