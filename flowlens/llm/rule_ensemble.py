"""Quality classifier: a sparse ensemble of rules over text statistics.

1. `statistics`: numbers of each whole text (shares of upper-case letters,
   digits, marks; words, distinct words, repeated words and lines, ...), as
   numpy sums over the bytes of Arrow batches.
2. Rules: boosted regression trees on a bounded sample of labelled rows; the
   path to every inner node and leaf is a conjunction of comparisons.
3. Weights: logistic regression with an L1 penalty over the rules (proximal
   gradient with momentum), which leaves few of them.
4. `Rules.score` is a Spark column over the statistics: the sum of the weights
   of the rules that hold, through the logistic function.

Labels are used of rows given as training rows only; the sample is about the
SAMPLE rows (never more) with the smallest hash of their id, which is the bound
of everything that comes to the driver.

Defined results: null, empty and blank texts have all statistics 0 and a score
like other texts; null labels and labels without a document are left out; ids
with several labels count once each; without labels of both kinds every rule
has weight 0 and the score is the share of label 1 (0.5 without any); an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.text import U, Words, groups, mix, trimmed, utf8, words
from flowlens.session import configure

SAMPLE = 20_000
TREES, DEPTH, LEAF, CUTS, RATE = 40, 3, 20, 24, 0.2
PENALTY, STEPS = 2e-3, 400

NAMES = ("log_bytes", "log_words", "mean_word", "long_words", "upper", "digits", "marks", "odd_marks", "spaces", "breaks",
         "bytes_high", "distinct_words", "top_repeat", "repeated_pairs", "distinct_lines", "mean_line", "upper_words",
         "marked_words", "bars", "stops")

_CLASS = np.zeros((256, 9), np.float32)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~",
                             b"#$%&*@^~<>{}[]\\|_=!", b" \t\v\f\r", b"\n", bytes(range(128, 256)), b"|", b".!?")):
    _CLASS[list(_chars), _i] = 1
_KINDS = _CLASS.T.astype(bool).copy()


def _per_range(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set places in each of the ranges at[i]:at[i + 1]."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), at))


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each owner."""
    if not len(values):
        return np.zeros(n)
    key = mix(values ^ mix(owner.astype(U) + U(1)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(owner[first], minlength=n).astype(float)


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, base = len(offsets) - 1, int(offsets[0])
    b, at = data[base:int(offsets[-1])], offsets - base
    size = np.diff(at).astype(float)
    upper, digits, marks, odd, spaces, breaks, high, bars, stops = (_per_range(k[b], at) for k in _KINDS)
    w: Words = words(data, offsets)
    count = np.diff(w.first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(w.first))
    length = w.end - w.start
    one = lambda x: np.maximum(x, 1)
    total = np.bincount(owner, length, n)
    long_words = np.bincount(owner, length > 12, n)
    distinct = _distinct(w.hash, owner, n)
    same_next = np.zeros(len(w.hash))
    same_next[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    same = owner[1:] == owner[:-1]
    pair = mix(w.hash[1:] * U(3) + w.hash[:-1])[same] if len(w.hash) > 1 else np.zeros(0, U)
    pair_owner = owner[1:][same] if len(owner) > 1 else np.zeros(0, np.int64)
    pairs = np.bincount(pair_owner, minlength=n)
    first_byte, last_byte = data[w.start], data[w.end - 1]
    second = data[np.minimum(w.start + 1, w.end - 1)]
    is_upper = _KINDS[0]
    shouting = np.bincount(owner, is_upper[first_byte] & is_upper[second] & (length > 1), n)
    marked = np.bincount(owner, _KINDS[3][last_byte], n)
    # lines: hashes of their words in order, blank ones left out
    line_of = np.searchsorted(np.flatnonzero(_KINDS[5][b]), w.start - base)
    line_key = line_of + owner  # a document's end also ends a line
    opens = np.flatnonzero(np.diff(line_key, prepend=-1))
    lines = np.add.reduceat(w.hash * (mix(np.arange(len(w.hash), dtype=U) - np.repeat(opens, np.diff(np.append(opens, len(w.hash)))).astype(U)) | U(1)), opens) \
        if len(opens) else np.zeros(0, U)
    line_owner = owner[opens]
    n_lines = np.bincount(line_owner, minlength=n)
    return np.stack([
        np.log1p(size), np.log1p(count), total / one(count), long_words / one(count), upper / one(size),
        digits / one(size), marks / one(size), odd / one(size), spaces / one(size), breaks / one(size), high / one(size),
        distinct / one(count), np.bincount(owner, same_next, n) / one(count),
        (pairs - _distinct(pair, pair_owner, n)) / one(pairs), _distinct(lines, line_owner, n) / one(n_lines),
        np.log1p(total / one(n_lines)), shouting / one(count), marked / one(count), bars / one(count),
        stops / one(count)], 1).round(9)


def _batch_statistics(column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    parts = [_statistics(data, offsets[i:j + 1]) for i, j in groups(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


STRUCT = T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES])


def with_statistics(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """`docs` with the struct column `name` of statistics; other columns may
    have any names, repeated ones too."""
    place, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for batch in batches:
            values = _batch_statistics(batch.column(place))
            stats = pa.StructArray.from_arrays([pa.array(v) for v in values.T], list(NAMES))
            yield batch.append_column(name, stats)

    fields = [T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)]
    return docs.toDF(*[f.name for f in fields]).mapInArrow(trimmed(run), T.StructType([*fields, T.StructField(name, STRUCT)])) \
        .toDF(*names, name)


# ---------------------------------------------------------------- training on the bounded sample

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, cut) all of which hold


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """A regression tree on gradients; the paths to its nodes and its output."""
    rules, out = [], np.zeros(len(g))

    def grow(rows: np.ndarray, path: Rule, depth: int) -> None:
        if path:
            rules.append(path)
        best = (1e-9, -1, 0)
        if depth < DEPTH and len(rows) >= 2 * LEAF:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f in range(x.shape[1]):
                k = len(cuts[f]) + 1
                if k < 2:
                    continue
                bg = np.cumsum(np.bincount(bins[rows, f], g[rows], k))[:-1]
                bh = np.cumsum(np.bincount(bins[rows, f], h[rows], k))[:-1]
                bn = np.cumsum(np.bincount(bins[rows, f], minlength=k))[:-1]
                gain = bg**2 / (bh + 1) + (total_g - bg)**2 / (total_h - bh + 1) - total_g**2 / (total_h + 1)
                gain[(bn < LEAF) | (len(rows) - bn < LEAF)] = 0
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], f, j)
        if best[1] < 0:
            out[rows] = g[rows].sum() / (h[rows].sum() + 1)
            return
        _, f, j = best
        low = bins[rows, f] <= j
        grow(rows[low], (*path, (f, False, float(cuts[f][j]))), depth + 1)
        grow(rows[~low], (*path, (f, True, float(cuts[f][j]))), depth + 1)

    grow(np.arange(len(g)), (), 0)
    return rules, out


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) == above
    return out


def _lasso(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Weights of an L1-penalised logistic regression; the intercept is free."""
    n, k = z.shape
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    w = v = np.zeros(k)
    c = d = bias
    step = 4 * n / (np.linalg.norm(z, 2) ** 2 + n)
    t = 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(z @ v + d))) - y
        new_w = v - step * (z.T @ r) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * PENALTY, 0)
        new_c = d - step * r.mean()
        new_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, d = new_w + (t - 1) / new_t * (new_w - w), new_c + (t - 1) / new_t * (new_c - c)
        w, c, t = new_w, new_c, new_t
    return float(c), w


@dataclass
class Rules:
    bias: float
    rules: list[Rule]
    weights: list[float]

    def score(self, name: str) -> Column:
        """Probability of label 1 as a column over the struct of statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for f, above, cut in rule:
                value = F.col(name)[NAMES[f]]
                holds = holds & ((value > cut) if above else (value <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Rules(float(np.log((share + 1e-3) / (1 - share + 1e-3))), [], [])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rules, out = _tree(x, bins, cuts, y - p, p * (1 - p))
        margin += RATE * out
        found.update(dict.fromkeys(rules))
    columns, kept = [], []
    seen: set[bytes] = set()
    for rule in found:
        z = _holds(rule, x)
        if 0 < z.sum() < len(z) and (key := np.packbits(z).tobytes()) not in seen:
            seen.add(key)
            columns.append(z)
            kept.append(rule)
    bias, weights = _lasso(np.stack(columns, 1).astype(float), y)
    chosen = [i for i in range(len(kept)) if weights[i] != 0]
    return Rules(bias, [kept[i] for i in chosen], [float(weights[i]) for i in chosen])


def train(statistics: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample: int = SAMPLE) -> Rules:
    """Rules from `statistics` (id, stats) and `labels` (id, label); of the
    labelled rows the `sample` ones with the smallest id hash are used."""
    stats = statistics.select(F.col(id_col).alias("id"), "stats")
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    known = marks.where("y is not null")
    # few rows above the bound leave their tasks, however many there are
    share = min(1.0, 1.1 * sample / max(1, known.count()))
    near = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40))
    rows = stats.join(known.where(near), "id").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40)), "id", "y").limit(sample) \
        .select("y", *[F.col("stats")[n].alias(n) for n in NAMES]).toPandas()
    return fit(rows[list(NAMES)].to_numpy(float), rows["y"].to_numpy(float))


def held_out(id_col: str, fold: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == 0


def quality_model(docs: DataFrame, labels: DataFrame, scratch, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", fold: int = 5) -> tuple[Rules, DataFrame]:
    """The rules learnt from labels of rows that aren't held out, and the
    statistics (id, stats) of all rows of `docs`."""
    configure(docs.sparkSession)
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    stats = scratch.write(with_statistics(slim, text_col, "stats").select(id_col, "stats"), "statistics")
    known = labels.where(~held_out(id_col, fold))
    return train(stats, known, id_col, label_col), stats
