"""SentencePiece segmentation by a batched Viterbi search in numpy.

A text is read as SentencePiece reads it: a space goes before it, and spaces
and the mark U+2581 are the same symbol. No piece goes on over a beginning run
of that symbol, so the words (a run of spaces and what follows) are segmented
alone, each distinct word once for a bounded cache.

Words of equal length advance together: at every end position the substrings of
each length are hashed out of prefix sums and probed in the sorted keys of the
pieces, and the best total score so far and its last piece are kept as
vectorised maxima. Among equal totals the longer last piece wins. A character
that is no piece costs UNKNOWN more than the lowest score and becomes its UTF-8
bytes' pieces.

The ids are those of the best-scoring segmentation under the file's scores.
Decoding joins the pieces' bytes and takes the first space away.

Defined results: null and empty texts have no ids; a text's marks U+2581 come
back as spaces, everything else as it was; rows are independent, so repeated
rows repeat results; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.text import U, mix
from flowlens.session import configure

MARK = "▁"
UNKNOWN = 10.0
CACHE = 1_200_000
#: Code points of the words that are segmented together.
CELLS = 1 << 17
TEXT_AT_ONCE = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(r" +[^ ]*|[^ ]+")

_models: dict[str, Pieces] = {}


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[0] = 1
    return np.cumprod(p, dtype=U)


class Pieces:
    """The pieces of a model file, and the words segmented so far."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = range(sp.get_piece_size())
        normal = [i for i in kinds if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        names = [sp.id_to_piece(i).replace(MARK, " ") for i in normal]
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes_of = [b""] * len(kinds)
        for i in kinds:
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
        for i, name in zip(normal, names):
            self.bytes_of[i] = name.encode()
        self.longest = max(map(len, names))
        keys = np.concatenate([self._keys([n])[0] for n in names])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int32)[order]
        self.scores = np.array([sp.get_score(i) for i in normal])[order]
        self.unknown = float(self.scores.min()) - UNKNOWN
        sizes = np.array([len(b) for b in self.bytes_of])
        self.size_of, self.at = sizes, np.append(0, np.cumsum(sizes))
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of hashed code points, and what takes a start away."""
        n = codes.shape[1]
        sums = np.zeros((len(codes), n + 1), U)
        np.cumsum(mix(codes.astype(U) + U(1)) * _powers(n, _BASE), axis=1, out=sums[:, 1:])
        return sums, _powers(n + 1, pow(_BASE, -1, 1 << 64))

    def _keys(self, words: list[str]) -> np.ndarray:
        """Keys of whole words of equal length, one row each."""
        codes = _codes(words)
        sums, _ = self._sums(codes)
        return mix(sums[:, -1:] + np.array([codes.shape[1]], U) * U(0xD6E8FEB86659FD93))

    def _segment(self, words: list[str]) -> None:
        """Best segmentations of words of equal length."""
        codes = _codes(words)
        count, n = codes.shape
        sums, back_to = self._sums(codes)
        best = np.full((n + 1, count), -np.inf)
        best[0] = 0
        size, piece = np.zeros((n + 1, count), np.int32), np.zeros((n + 1, count), np.int32)
        for end in range(1, n + 1):
            best[end], size[end], piece[end] = best[end - 1] + self.unknown, 1, -1
            for k in range(1, min(self.longest, end) + 1):
                key = mix((sums[:, end] - sums[:, end - k]) * back_to[end - k] + np.array([k], U) * U(0xD6E8FEB86659FD93))
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                total = np.where(self.keys[at] == key, best[end - k] + self.scores[at], -np.inf)
                better = (total >= best[end]) & (total > -np.inf)
                best[end][better], size[end][better], piece[end][better] = total[better], k, self.ids[at][better]
        on_path = np.zeros((count, n + 1), bool)
        rows, at = np.arange(count), np.full(count, n)
        while len(rows):
            on_path[rows, at] = True
            at = at - size[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        row, end = np.nonzero(on_path)
        ids = piece[end, row]
        cuts = np.searchsorted(row, np.arange(count + 1)).tolist()
        strange = set(row[ids < 0].tolist())
        for i, word in enumerate(words):
            own = ids[cuts[i]:cuts[i + 1]]
            if i in strange:
                parts = [self.byte_ids[list(word[e - 1].encode())] if p < 0 else np.array([p], np.int32)
                         for p, e in zip(own.tolist(), end[cuts[i]:cuts[i + 1]].tolist())]
                own = np.concatenate(parts)
            self.known[word] = own.astype(np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids (little-endian 32-bit) of each text."""
        split = [_WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        words = {w for s in split for w in s}
        missing = [w for w in words if w not in self.known]
        if len(self.known) + len(missing) > CACHE:
            self.known.clear()
            missing = list(words)
        by_length: dict[int, list[str]] = {}
        for w in missing:
            by_length.setdefault(len(w), []).append(w)
        for n, same in by_length.items():
            step = max(1, CELLS // n)
            for at in range(0, len(same), step):
                self._segment(same[at:at + step])
        return [b"".join(map(self.known.__getitem__, s)) for s in split]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of lists of ids, all lists together."""
        flat = np.frombuffer(b"".join(ids), np.int32)
        sizes = self.size_of[flat]
        ends = np.cumsum(sizes)
        take = np.repeat(self.at[flat] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        data = self.flat[take].tobytes()
        stops = np.append(0, ends)[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(stops[:-1], stops[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


CODED = "id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _rows_of(batch: pa.RecordBatch, column: int):
    at, size = 0, 0
    for i, value in enumerate(batch.column(column)):
        n = len(value.as_buffer()) if value.is_valid else 0
        if size and size + n > TEXT_AT_ONCE:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def piece_ids(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row of `docs`."""
    configure(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in _rows_of(batch, 1):
                ids = pieces(model).encode(part.column(1).to_pylist())
                at = pa.array(np.cumsum([0, *(len(i) // 4 for i in ids)]), pa.int32())
                lists = pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def encode_and_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: number and CRC-32 of its ids, digest of the
    text decoded from them, and whether that is the text again."""
    configure(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in _rows_of(batch, 1):
                texts = part.column(1).to_pylist()
                ids = pieces(model).encode(texts)
                back = pieces(model).decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                     pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()),
                     pa.array([(t or "").replace(MARK, " ") == b for t, b in zip(texts, back)], pa.bool_())],
                    [c.split()[0] for c in CODED.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, CODED).withColumnRenamed("id", id_col)
