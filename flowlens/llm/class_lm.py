"""Language-model scores from Brown class-based bigrams.

P(w | w') = P(c(w) | c(w')) * P(w | c(w)): classes by exchange clustering, class
transitions and word emissions counted over the whole training part.

1. Words are counted over all training texts (map-side sums, then one
   shuffle), which gives N, V and every word's count.
2. The VOCABULARY most frequent words are moved one after the other, each to
   the class that raises the classes' mutual information most, over bigram
   counts of the whole training part; their table has a fixed size.
3. All other words that occur LEAST times are moved in sweeps, each a Spark job:
   a pass over the texts counts the classes before and after every word, the
   counts meet by ranges of the words' hashes, and every word goes where the
   gain over the class table is largest, all at the same time. Words occurring
   less, and words that training never saw, are one class more: words seen once
   tell what new ones follow.
4. Every text is scored: transitions and the counts of the most frequent words
   (TABLE at most) come from tables of fixed size; the counts of rarer words by a join on the
   word, of which a text sends each distinct one once.

Classes are kept by the low bits of the word's hash, a byte for each of SLOTS
slots, so the table that tasks get has the same size for any corpus; words of
one slot share their class, and are moved as one.

Tokens are words outside [\\x20\\x09-\\x0D] with A-Z folded, then one end. A
transition is smoothed by one count a class, an emission by one count a word
and one more for all words that the class has never had. Each unseen word gets
that one count, so the probabilities of all possible words don't sum to one.

Defined results: a null text is empty and has the end as its only token; no
training text gives N = V = 0, a base score of 0 a token, and scores from
smoothing alone; rows with equal ids and texts repeat their results; an empty
table gives an empty result; other columns are not looked at. Words stand for
their 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.text import U, groups, utf8, words
from flowlens.session import Scratch, configure

VOCABULARY = 1024
CLASSES = 48
#: Classes of the words that aren't moved.
TAIL = 1
TABLE = 1 << 16
SWEEPS = 3
#: Occurrences from which on a word is moved.
LEAST = 2
#: Slots of the table of classes, and those that one reducer's step holds.
SLOTS = 1 << 25
PART = 1 << 15
#: Sweeps over the words that aren't among the most frequent ones.
WIDE_SWEEPS = 2
#: Hash that stands for the end of a text.
END = np.uint64(0x5851F42D4C957F2D)


def in_training(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 7 != 2


def _tokens(batch: pa.RecordBatch, texts: int, train: int | None = None):
    """(rows, hashes, first) of groups of texts: all tokens with the end of
    each text last; only training rows when `train` names their column."""
    if train is not None:
        batch = batch.take(pa.array(np.flatnonzero(batch.column(train).to_numpy(zero_copy_only=False).astype(bool))))
    data, offsets = utf8(batch.column(texts))
    for i, j in groups(offsets):
        w = words(data, offsets[i:j + 1])
        yield batch.slice(i, j - i), np.insert(w.hash, w.first[1:], END), w.first + np.arange(j - i + 1)


def _counted(keys: np.ndarray, names: list[str]) -> pa.RecordBatch:
    values, counts = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names)


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, c) over the training rows of (id, text, hash, train)."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, hashes, _ in _tokens(batch, 1, 3):
                held.append(hashes)
                size += len(hashes)
                if size > 3_000_000:  # summed before they are sent
                    yield _counted(np.concatenate(held), ["w", "c"])
                    held, size = [], 0
        if held:
            yield _counted(np.concatenate(held), ["w", "c"])

    return texts.mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _class_ids(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index among the sorted `known` hashes, or len(known) + tail class."""
    if not len(known):
        return (hashes % U(TAIL)).astype(np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, len(known) + (hashes % U(TAIL)).astype(np.int64))


def bigram_counts(texts: DataFrame, known: np.ndarray) -> DataFrame:
    """(pair, c): counts of neighbouring units over the training rows, a unit
    being a frequent word or a tail class; pair = first * units + second. The
    end also stands before a text."""
    shared = texts.sparkSession.sparkContext.broadcast(known)
    units = len(known) + TAIL

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for _, hashes, first in _tokens(batch, 1, 3):
                unit = _class_ids(hashes, shared.value)
                before = np.append(0, unit[:-1])
                before[first[:-1]] = _class_ids(np.array([END]), shared.value)[0]
                part = np.bincount(before * units + unit)
                if len(part) > len(total):
                    total = np.concatenate([total, np.zeros(len(part) - len(total), np.int64)])
                total[:len(part)] += part
        used = np.flatnonzero(total)
        for at in range(0, len(used), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(used[at:at + 50_000]), pa.array(total[used[at:at + 50_000]])],
                                             ["pair", "c"])

    return texts.mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))


def nlogn(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, movable: int, classes: int = CLASSES, tail: int = TAIL, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every unit of the square bigram table `counts`: the first
    `movable` units are moved among `classes` classes, the others keep one each.
    A unit moves where the sum of n log n over class bigrams, less that over
    both margins, is largest."""
    units = len(counts)
    total = classes + tail
    of = np.concatenate([np.argsort(np.argsort(-counts[:movable].sum(1), kind="stable"), kind="stable") % classes,
                         classes + np.arange(units - movable)]).astype(np.int64)

    member = np.zeros((units, total))
    member[np.arange(units), of] = 1
    after, before = counts @ member, counts.T @ member  # of each unit, by class of the neighbour
    table = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for u in range(movable):
            own, old = counts[u, u], of[u]
            row, col = after[u].copy(), before[u].copy()
            row[old] -= own
            col[old] -= own
            # the table without u
            table[old] -= row
            table[:, old] -= col
            table[old, old] -= own
            right, left = table.sum(1) + col, table.sum(0) + row  # the neighbours' margins count u in any class
            # gain of each class over its cells without u; the cell (k, k) gets row, column and own counts
            cells = (nlogn(table[:classes] + row) - nlogn(table[:classes])).sum(1) \
                + (nlogn(table[:, :classes].T + col) - nlogn(table[:, :classes].T)).sum(1)
            k = np.arange(classes)
            inner = table[k, k]
            cells += nlogn(inner + row[k] + col[k] + own) - nlogn(inner + row[k]) - nlogn(inner + col[k]) + nlogn(inner)
            size_r, size_l = row.sum() + own, col.sum() + own
            gain = cells - (nlogn(right[k] + size_r) - nlogn(right[k])) - (nlogn(left[k] + size_l) - nlogn(left[k]))
            new = int(np.argmax(gain))
            table[new] += row
            table[:, new] += col
            table[new, new] += own
            if new != old:
                moved += 1
                of[u] = new
                after[:, old] -= counts[:, u]
                after[:, new] += counts[:, u]
                before[:, old] -= counts[u]
                before[:, new] += counts[u]
        if not moved:
            break
    return of


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U(SLOTS - 1)).astype(np.int64)


class Classes:
    """Class of every slot; compressed on the way to the tasks."""

    def __init__(self, of: np.ndarray):
        self.of = of

    def __reduce__(self):
        return _unpacked, (pa.compress(self.of, "zstd", asbytes=True), len(self.of))


def _unpacked(packed: bytes, size: int) -> Classes:
    return Classes(np.frombuffer(pa.decompress(packed, size, "zstd", asbytes=True), np.uint8))


def _neighbours(of: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every token, of the one before and of the one after it in its
    text; before a text's first and after its last is the end."""
    own, end = of[_slots(hashes)].astype(np.int64), int(of[_slots(np.array([END]))[0]])
    before, after = np.append(end, own[:-1]), np.append(own[1:], end)
    before[first[:-1]] = end
    return own, before, after


def class_pairs(texts: DataFrame, shared: Broadcast) -> np.ndarray:
    """Counts of neighbouring classes over the training rows; `shared` are the
    Classes."""
    total = CLASSES + TAIL

    def run(batches):
        table = np.zeros(total * total, np.int64)
        for batch in batches:
            for _, hashes, first in _tokens(batch, 1, 3):
                own, before, _ = _neighbours(shared.value.of, hashes, first)
                table += np.bincount(before * total + own, minlength=total * total)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used])], ["pair", "c"])

    table = np.zeros(total * total)
    for pair, c in texts.mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c")).collect():  # total^2 rows
        table[pair] = c
    return table.reshape(total, total)


def contexts(texts: DataFrame, shared: Broadcast, fixed: np.ndarray) -> DataFrame:
    """(part, keys, counts): how often a slot of the part, but the `fixed` ones,
    occurs between two classes, in the training rows; key = (slot, class before,
    class after)."""
    names = ["part", "keys", "counts"]

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        part = keys // (PART << 12)
        at = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(keys))
        inside, counts = (keys % (PART << 12)).astype(np.uint32), counts.astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [pa.array(part[at[:-1]], pa.int32()), *[pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())
                                                   for x in (inside, counts)]], names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, hashes, first in _tokens(batch, 1, 3):
                slot, (_, before, after) = _slots(hashes), _neighbours(shared.value.of, hashes, first)
                free = fixed[np.minimum(np.searchsorted(fixed, slot), len(fixed) - 1)] != slot
                held.append(((slot << 12) + (before << 6) + after)[free])
                size += len(held[-1])
                if size > 3_000_000:  # summed before they are sent
                    yield summed(held)
                    held, size = [], 0
        if size:
            yield summed(held)

    return texts.mapInArrow(run, "part int, keys binary, counts binary")


def gains(side: np.ndarray, table: np.ndarray, old: np.ndarray) -> np.ndarray:
    """(words, classes): growth of the sum of n log n over the cells of
    `table[:, k]`, when a word with the neighbour counts `side` (words, classes)
    joins class k; a word is taken out of its class `old` first."""
    out = np.zeros((len(side), CLASSES))
    word, near = np.nonzero(side)
    grown = nlogn(table)
    for at in range(0, len(word), 1 << 16):
        w, k = word[at:at + (1 << 16)], near[at:at + (1 << 16)]
        x = side[w, k].astype(float)
        part = nlogn(table[k, :CLASSES] + x[:, None]) - grown[k, :CLASSES]
        inside = np.flatnonzero(old[w] < CLASSES)
        cell = table[k[inside], old[w[inside]]]
        part[inside, old[w[inside]]] = nlogn(cell) - nlogn(np.maximum(cell - x[inside], 0))
        first = np.flatnonzero(np.diff(w, prepend=-1))
        out[w[first]] += np.add.reduceat(part, first)
    return out


def best_classes(before: np.ndarray, after: np.ndarray, table: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The class that each word gains most from, by its counts of the classes
    before and after it; the other words stay where they are."""
    n = after.sum(1).astype(float)
    gain = gains(before, table, old) + gains(after, table.T, old)
    for margin in (table.sum(0), table.sum(1)):
        size = np.repeat(margin[None, :CLASSES], len(n), 0)
        inside = np.flatnonzero(old < CLASSES)
        size[inside, old[inside]] = np.maximum(size[inside, old[inside]] - n[inside], 0)
        gain -= nlogn(size + n[:, None]) - nlogn(size)
    return gain.argmax(1)


def sweep(texts: DataFrame, shared: Broadcast, fixed: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Classes of all slots after one move of every word that occurs LEAST times,
    but those in the `fixed` slots (sorted)."""
    total = CLASSES + TAIL

    def moved(part: int, row: np.ndarray, before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        own = shared.value.of[part * PART:(part + 1) * PART].copy()
        used = np.flatnonzero(row >= 0)
        before, after = before.reshape(-1, total)[row[used]], after.reshape(-1, total)[row[used]]
        often = after.sum(1) >= LEAST
        used, before, after = used[often], before[often], after[often]
        own[used] = best_classes(before, after, table, own[used].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array(
            [pa.compress(own, "zstd", asbytes=True)], pa.binary())], ["part", "classes"])

    def run(batches):
        at = None
        for batch in batches:
            for part, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    if at is not None:
                        yield moved(at, row, before, after)
                    at, row, rows = part, np.full(PART, -1), 0
                    before, after = np.zeros(0, np.int64), np.zeros(0, np.int64)
                keys, counts = np.frombuffer(keys, np.uint32).astype(np.int64), np.frombuffer(counts, np.uint32)
                slot = keys >> 12
                new = np.unique(slot[row[slot] < 0])
                row[new] = rows + np.arange(len(new))
                rows += len(new)
                if rows * total > len(before):  # doubled, up to PART rows
                    more = np.zeros(max(rows * total, 2 * len(before)) - len(before), np.int64)
                    before, after = np.append(before, more), np.append(after, more)
                np.add.at(before, row[slot] * total + (keys >> 6 & 63), counts)
                np.add.at(after, row[slot] * total + (keys & 63), counts)
        if at is not None:
            yield moved(at, row, before, after)

    rows = contexts(texts, shared, fixed).repartition("part").sortWithinPartitions("part") \
        .mapInArrow(run, "part int, classes binary")
    of = shared.value.of.copy()
    for part, classes in rows.collect():  # a byte a slot at most
        of[part * PART:(part + 1) * PART] = np.frombuffer(pa.decompress(classes, PART, "zstd", asbytes=True), np.uint8)
    return of


def class_sizes(counts: DataFrame, shared: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of every class."""
    total = CLASSES + TAIL

    def run(batches):
        for batch in batches:
            k = shared.value.of[_slots(batch.column(0).to_numpy().view(U))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(total)), pa.array(np.bincount(k, batch.column(1).to_numpy(), total).astype(np.int64)),
                 pa.array(np.bincount(k, minlength=total).astype(np.int64))], ["k", "c", "v"])

    tokens, distinct = np.zeros(total), np.zeros(total)
    for k, c, v in counts.mapInArrow(run, "k long, c long, v long").groupBy("k").agg(F.sum("c"), F.sum("v")).collect():
        tokens[k], distinct[k] = c, v
    return tokens, distinct


class Model:
    """Tables of fixed size that every task gets."""

    def __init__(self, of: np.ndarray, pairs: np.ndarray, table_words: np.ndarray,
                 table_counts: np.ndarray, n: int, v: int, class_tokens: np.ndarray, class_words: np.ndarray):
        self.slots = Classes(of)
        total = CLASSES + TAIL
        self.transition = np.log10((pairs + 1) / (pairs.sum(1, keepdims=True) + total))
        self.words, self.counts = table_words, table_counts
        self.n, self.v = n, v
        self.emission_of = np.log10(class_tokens + class_words + 1.0)

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        return self.slots.of[_slots(hashes)]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of the most frequent words, 0 for all others."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.counts[at], 0)


def fit(texts: DataFrame, counts: DataFrame) -> Model:
    """The model of the training rows of (id, text, hash, train) and their
    `word_counts`."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # words at least as frequent as a step of counts that TABLE words reach at most
    step = F.floor(F.log2("c") * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # 16 a power of two
    least, room = 1 << 30, TABLE
    for s, size in sorted(map(tuple, steps), reverse=True):
        if size > room:
            break
        least, room = s, room - size
    top = counts.where(step >= least).toPandas().sort_values(["c", "w"], ascending=[False, True])  # TABLE rows at most
    hashes, often = top["w"].to_numpy(np.int64).view(U), top["c"].to_numpy(np.int64)
    first = hashes[:VOCABULARY]
    if len(first) < VOCABULARY:  # a step of more than TABLE words is among the first
        first = counts.orderBy(F.desc("c"), "w").limit(VOCABULARY).toPandas()["w"].to_numpy(np.int64).view(U)
    known = np.sort(first)
    units = len(known) + TAIL
    table = np.zeros(units * units)
    pairs = bigram_counts(texts, known).toPandas()  # (VOCABULARY + TAIL)^2 rows at most
    table[pairs["pair"].to_numpy(np.int64)] = pairs["c"].to_numpy(float)
    of = np.full(SLOTS, CLASSES, np.uint8)
    of[_slots(known)] = exchange(table.reshape(units, units), len(known))[:len(known)]
    send = texts.sparkSession.sparkContext.broadcast
    shared = send(Classes(of))
    table = class_pairs(texts, shared)
    for _ in range(WIDE_SWEEPS if n else 0):
        of = sweep(texts, shared, np.unique(_slots(known)), table)
        shared.destroy()  # its jobs are done
        shared = send(Classes(of))
        table = class_pairs(texts, shared)
    tokens_in, words_in = class_sizes(counts, shared)
    shared.destroy()
    order = np.argsort(hashes)
    return Model(of, table, hashes[order], often[order], n, v, tokens_in, words_in)


SCORED = "id long, hash long, w long, tf long, n_tokens long, n_known long, logs double, fixed double"


def partial_scores(texts: DataFrame, model: Model) -> DataFrame:
    """A row for each text with what the tables give (w null), and one for each
    of its distinct rarer words. `logs` sums log10(c + 1), which base score and
    emissions share; `fixed` sums what doesn't need a word's count."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m: Model = shared.value
        for batch in batches:
            for rows, hashes, first in _tokens(batch, 1):
                n = rows.num_rows
                owner = np.repeat(np.arange(n), np.diff(first))
                own, before, _ = _neighbours(m.slots.of, hashes, first)
                fixed = np.bincount(owner, m.transition[before, own] - m.emission_of[own], n)
                count = m.lookup(hashes)
                known = count > 0
                logs = np.bincount(owner, np.log10(count + 1.0), n)
                rare_owner, rare = owner[~known], hashes[~known]
                order = np.lexsort((rare, rare_owner))
                rare_owner, rare = rare_owner[order], rare[order]
                at = np.flatnonzero((np.diff(rare_owner, prepend=-1) != 0) | (np.append(True, rare[1:] != rare[:-1])))
                tf = np.diff(np.append(at, len(rare)))
                ids, keys = rows.column(0), rows.column(2)
                pick = pa.array(rare_owner[at])
                yield pa.RecordBatch.from_arrays(
                    [ids, keys, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.diff(first)),
                     pa.array(np.bincount(owner, known, n).astype(np.int64)), pa.array(logs), pa.array(fixed)], NAMES)
                if len(at):
                    k = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pick), keys.take(pick), pa.array(rare[at].view(np.int64)), pa.array(tf),
                         *[pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]], NAMES)

    return texts.mapInArrow(run, SCORED)


NAMES = [c.split()[0] for c in SCORED.split(", ")]


def class_lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None) -> DataFrame:
    """One row per row of `docs`: held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigram) and score (class bigrams), both log10."""
    spark = configure(docs.sparkSession)
    scratch = Scratch(spark, "class-lm")
    train = in_training(F.col(id_col)) if train is None else train
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.xxhash64(text_col).alias("hash"), F.coalesce(train, F.lit(True)).alias("train"))

    counts = scratch.write(word_counts(texts), "counts")
    model = fit(texts, counts)
    n, v = model.n, model.v

    scored = scratch.write(partial_scores(texts, model), "scored")
    rare = scored.where("w is not null").select("id", "hash", "w", "tf").join(counts, "w") \
        .groupBy("id", "hash").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more_logs"), F.sum("tf").alias("more_known"))
    texts_rows = scored.where("w is null").drop("w", "tf")
    copies = rare.withColumnRenamed("id", "rare_id").withColumnRenamed("hash", "rare_hash")
    rows = texts_rows.join(copies, F.col("id").eqNullSafe(F.col("rare_id")) & (F.col("hash") == F.col("rare_hash")), "left")
    # rows with the same id and text send their rare words together
    same = texts_rows.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("same")).where("same > 1") \
        .toDF("same_id", "same_hash", "same")
    rows = rows.join(same, F.col("id").eqNullSafe(F.col("same_id")) & (F.col("hash") == F.col("same_hash")), "left")
    share = F.coalesce("same", F.lit(1))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) / share
    known_tokens = F.col("n_known") + (F.coalesce("more_known", F.lit(0)) / share).cast("long")
    per_token = math.log10(n + v + 1) if n else 0.0
    out = rows.select(
        F.col("id").alias(id_col), (~F.coalesce(in_training(F.col("id")), F.lit(True))).alias("held_out"), "n_tokens",
        known_tokens.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.lit(per_token) * F.col("n_tokens")).alias("base_score"), (logs + F.col("fixed")).alias("score"))
    out = scratch.write(out, "result")
    scratch.keep_only("result")
    return out
