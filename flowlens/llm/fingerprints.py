"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text's paragraphs (its lines) are hashed with SHA-256, each digest is read as
four numbers of 60 bits, and the fingerprint is a vector of sums over all
paragraphs modulo 2^60:

* 4 lanes sum the numbers themselves. Two texts with the same paragraphs, in
  any order, have equal sums; others differ but with negligible probability.
* 20 lanes sum the first number's bits, three bits a lane (bits k, k + 20 and
  k + 40 of lane k, 20 binary places apart, so they don't run into each other
  below 2^20 paragraphs). Taken as +1 / -1 they are 60 random signs a
  paragraph, and the squared distance of two such sums estimates how many
  paragraphs only one of the texts has.
* 1 lane counts the paragraphs.

`combine` and `remove` add and subtract whole vectors, so paragraphs can be
inserted into and deleted from a fingerprint without the rest of the text.

Everything is a Spark column expression over the row itself; the query's edited
texts need the neighbour in id order, which is found in one exchange: ids are
dealt out by sampled splitters, and the row at a splitter also goes to the
range above it, whose last row it follows.

Defined results: a null text is empty, an empty text has one empty paragraph;
rows are ordered by descending id, equal ids by text, null ids last; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import configure

BITS = 60
WORDS = 4
SHIFTS = 20
LANES = WORDS + SHIFTS + 1
_ALL = (1 << BITS) - 1
_SIGNS = (1 << 0) | (1 << 20) | (1 << 40)
_FIELD = (1 << 20) - 1


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _add(a: Column, b: Column) -> Column:
    return (a + b).bitwiseAND(_long(_ALL))


def fingerprint(text: Column) -> Column:
    """array<long> of LANES sums over the paragraphs of `text`."""
    digests = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: F.sha2(p, 256))
    numbers = F.transform(digests, lambda d: F.array(*[
        F.conv(F.substring(d, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(WORDS)]))

    def step(total: Column, x: Column) -> Column:
        first = x[0]
        return F.array(
            *[_add(total[i], x[i]) for i in range(WORDS)],
            *[_add(total[WORDS + k], F.shiftright(first, k).bitwiseAND(_long(_SIGNS))) for k in range(SHIFTS)],
            total[LANES - 1] + _long(1))

    return F.aggregate(numbers, F.array_repeat(_long(0), LANES), step)


def combine(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return F.zip_with(a, b, _add)


def remove(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of `a` without those of `b`, which it must have."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(_long(_ALL)))


def as_text(vector: Column) -> Column:
    """Lower-case hexadecimal, 15 digits a lane."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def _signs(vector: Column) -> Column:
    """The 60 sums of +1 / -1: twice the count of set bits less the paragraphs."""
    packed = F.slice(vector, WORDS + 1, SHIFTS)

    def fields(shift: int) -> Column:
        return F.transform(packed, lambda x: F.shiftright(x, shift).bitwiseAND(_long(_FIELD)))

    return F.transform(F.concat(fields(0), fields(20), fields(40)), lambda c: _long(2) * c - vector[LANES - 1])


def _square(values: Column) -> Column:
    return F.aggregate(values, _long(0), lambda s, x: s + x * x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: estimated share of paragraphs that two texts have in common
    (twice the common ones by all); 1 for equal fingerprints."""
    x, y = _signs(a), _signs(b)
    apart = _square(F.zip_with(x, y, lambda p, q: p - q))
    total = _square(x) + _square(y)
    rough = F.greatest(F.lit(0.0), F.lit(1.0) - apart.cast("double") / F.greatest(total, _long(1)).cast("double"))
    return F.when(a == b, F.lit(1.0)).otherwise(rough)


def _range_of(id_col: Column, splitters: list[int]) -> Column:
    """Number of splitters below the id (null: 0), looked up in two steps."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i:i + step] for i in range(0, len(splitters), step)]
    table = F.array(*[F.array(*[_long(s) for s in b]) for b in blocks])
    tops = F.array(*[_long(b[-1]) for b in blocks])
    before = F.size(F.filter(tops, lambda s: s < id_col))
    within = F.coalesce(F.size(F.filter(F.get(table, before), lambda s: s < id_col)), F.lit(0))
    return F.when(id_col.isNull(), F.lit(0)).otherwise(
        F.least(before * step, F.lit(len(splitters))) + F.when(before < len(blocks), within).otherwise(0))


def with_next(docs: DataFrame, id_col: str, order: list[Column], columns: list[str], ranges: int = 0) -> DataFrame:
    """`docs` with next_<column> of the row that follows in descending id order
    (`order` breaks ties of the id); the first row follows the last."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array(F.lit(0.5))
    at = docs.agg(F.percentile_approx(id_col, shares, F.lit(20 * ranges)).alias("s"), F.max(id_col).alias("top")).first()
    splitters = sorted(set(at["s"] or []))
    ids = F.col(id_col)
    # a row at a splitter is the largest of its range and follows the range above; the first row follows the lowest
    copies = [F.struct(_range_of(ids, splitters).alias("range"), F.lit(0).alias("ghost"))]
    if splitters:
        copies.append(F.when(ids.isin(splitters), F.struct((_range_of(ids, splitters) + 1).alias("range"), F.lit(1).alias("ghost"))))
    copies.append(F.when(ids.eqNullSafe(F.lit(at["top"]).cast("long")), F.struct(F.lit(0).alias("range"), F.lit(2).alias("ghost"))))
    dealt = docs.withColumn("at", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
    w = Window.partitionBy("at.range").orderBy("at.ghost", ids.desc_nulls_last(), *order)
    following = [F.lead(c).over(w).alias(f"next_{c}") for c in columns]
    return dealt.select("*", *following).where("at.ghost = 0").drop("at")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the first
    code points of the next document (descending id) replace the last half."""
    configure(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = with_next(texts.withColumn("vector", fingerprint(F.col("text"))), "id",
                       [F.xxhash64("text").asc(), F.col("text").asc()], ["text", "vector"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    out = marked.withColumn("edited", edited)
    out = out.select("id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                     "vector", "next_vector", fingerprint(F.col("edited")).alias("edited_vector"))
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("vector")).alias("fingerprint"),
        as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"))


def merge_fingerprints(parts: list[Column]) -> Column:
    """Fingerprint of a document out of those of its disjoint sets of paragraphs."""
    return reduce(combine, parts)
