"""Sharding by balanced label propagation.

Law `rows`: the row counts of any two shards differ by one at most. Documents
of one group (by default: of equal texts) are linked with each other; an edge
between two shards is cut.

Rows are numbered when they are written, by partition and place, so that a
row's ordinal needs no sort. Each starts in shard ordinal modulo the number of
shards, which already meets the law. The linked documents of one group in one
shard are alike, so they are one block (group, shard, rows). A round, as joins
and aggregates over blocks:

1. every block proposes the shard that most of its group's documents are in
   (ties: by a hash of the round), if that isn't its own;
2. the proposed rows between each two shards, a table of shards x shards, give
   the quotas: the largest movement found under which no shard takes more than
   it gives away plus its room (its share of all rows less its linked rows;
   documents without a link take what is left at the end);
3. proposals of a pair of shards are taken by the size of the neighbours that
   they join, largest first, up to the quota: their running totals are exact,
   a window within (pair, size class, hash bucket) plus the totals before it. The
   block at the border moves in part.

Every second round proposes only shards with room, so that a group larger than
a shard goes on to a second one. Each row moved raises the sum of squares of
the blocks, so the rounds end; they stop when IDLE in turn move nothing, or
after `rounds` of them: the law holds after any number. At the end a group's
rows are dealt to its blocks in order, and documents without a link fill the
shards up to their shares.

All of it is DataFrame operations; what reaches the driver is the table of
shards x shards of a round.

Defined results: a null text is empty, size 1, and equals the empty one; null
and repeated ids are rows like others; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import Scratch, configure

SHARDS = 8
ROUNDS = 30
IDLE = 4
#: Hash buckets within a pair of shards and a size class.
BUCKETS = 256
#: Rows of a group that are numbered in one window.
PART = 1 << 16

#: monotonically_increasing_id() counts rows of a partition in its low bits.
_PLACE = 33


def quotas(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Rows that may move from s to t of those that want to, so that no shard
    takes more than it gives plus its room. Cut down until that holds; what a
    shard can't take also counts no more as leaving another."""
    x = dict(wanted)
    while True:
        over = False
        for t in range(len(room)):
            into = [(k, v) for k, v in sorted(x.items()) if k[1] == t and v]
            have = sum(v for _, v in into)
            may = sum(v for k, v in x.items() if k[0] == t) + room[t]
            if have > may:
                over = True
                given = 0
                for k, v in into:
                    x[k] = v * may // have
                    given += x[k]
                for k, v in into:  # what the roundings left over
                    more = min(v - x[k], may - given)
                    x[k] += more
                    given += more
        if not over:
            return {k: v for k, v in x.items() if v}


def _literal(values: dict, *key: Column) -> Column:
    """A small dict as a map literal, null where a key is missing."""
    name = F.concat_ws(",", *key) if len(key) > 1 else key[0].cast("string")
    if not values:
        return F.lit(None).cast("long")
    pairs = [F.lit(x) for k, v in values.items()
             for x in (",".join(map(str, k)) if isinstance(k, tuple) else str(k), v)]
    return F.create_map(*pairs)[name]


def _proposals(blocks: DataFrame, open_shards: list[int], turn: int) -> DataFrame:
    """Blocks with the open shard `to` that holds most of their group, where
    that is more than their own; `near` is the number of rows there."""
    rank = F.struct("rows", F.xxhash64("group", "shard", F.lit(turn)).alias("tie"), "shard")
    best = blocks.where(F.col("shard").isin(open_shards)).groupBy("group").agg(F.max(rank).alias("best"))
    return blocks.withColumn("own", rank).join(best, "group").where("best > own") \
        .select("group", "shard", "rows", F.col("best.shard").alias("to"), F.col("best.rows").alias("near"))


def _moved(proposals: DataFrame, quota: dict[tuple[int, int], int]) -> DataFrame:
    """Proposals with the rows `m` that move, by exact running totals."""
    limited = proposals.withColumn("quota", _literal(quota, F.col("shard"), F.col("to"))).where("quota is not null") \
        .withColumn("class", -F.floor(F.log2("near")).cast("int")) \
        .withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(BUCKETS)).cast("int"))
    place = ["shard", "to", "class", "bucket"]
    # shards^2 x 64 x BUCKETS rows at the most
    before = limited.groupBy(*place).agg(F.sum("rows").alias("all")) \
        .withColumn("before", F.sum("all").over(Window.partitionBy("shard", "to").orderBy("class", "bucket")) - F.col("all")) \
        .drop("all")
    running = F.sum("rows").over(Window.partitionBy(*place).orderBy(F.col("near").desc(), "group")
                                 .rowsBetween(Window.unboundedPreceding, -1))
    return limited.withColumn("here", F.coalesce(running, F.lit(0))).join(before, place) \
        .withColumn("m", F.least("rows", F.col("quota") - F.col("before") - F.col("here"))).where("m > 0") \
        .select("group", "shard", "to", "m")


def propagate(blocks: DataFrame, shares: list[int], scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """Blocks (group, shard, rows) whose rows in each shard don't exceed its
    share -> the blocks after the propagation, for which the same holds."""
    number = len(shares)
    idle, now = 0, "blocks-0"
    blocks = scratch.write(blocks, now)
    for k in range(1, rounds + 1):
        loads = dict(blocks.groupBy("shard").agg(F.sum("rows")).collect())  # one row a shard
        room = [shares[s] - loads.get(s, 0) for s in range(number)]
        allowed = list(range(number)) if k % 2 else [s for s in range(number) if room[s] > 0]
        asked = scratch.write(_proposals(blocks, allowed, k), f"asked-{k}")
        wanted = {(s, t): n for s, t, n in asked.groupBy("shard", "to").agg(F.sum("rows")).collect()}  # shards x shards
        quota = quotas(wanted, room)
        if not quota:
            idle += 1
            scratch.drop(f"asked-{k}")
            if idle == IDLE or (k % 2 and not wanted):  # no group left in two shards
                break
            continue
        idle = 0
        moved = scratch.write(_moved(asked, quota), f"moved-{k}")
        changed = blocks.unionByName(moved.select("group", "shard", (-F.col("m")).alias("rows"))) \
            .unionByName(moved.select("group", F.col("to").alias("shard"), F.col("m").alias("rows")))
        blocks = scratch.write(changed.groupBy("group", "shard").agg(F.sum("rows").alias("rows")).where("rows > 0"),
                               f"blocks-{k}")
        scratch.drop(now, f"asked-{k}", f"moved-{k}")
        now = f"blocks-{k}"
    return blocks


def _partition(row: Column) -> Column:
    return F.shiftright(row, _PLACE)


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None,
                    shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of `docs`: its id, size (UTF-8 bytes and one), text_crc32,
    law, shard, slot (gapless from 0 in each shard), grown_shard (null: of the
    law `key` only). Rows with the same value of `group`, by default the text's
    digest, are linked; null is no group."""
    spark = configure(docs.sparkSession)
    scratch = Scratch(spark, "label-shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256)) if group is None else F.unhex(F.sha2(group.cast("string"), 256))
    nodes = scratch.write(
        docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                    F.crc32(text).alias("crc"), digest.alias("group"))
        .withColumn("row", F.monotonically_increasing_id()), "nodes")

    # one row a task of the scan
    part_sizes = nodes.groupBy(_partition(F.col("row")).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = scratch.write(part_sizes.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start")), "starts")
    total = nodes.count()
    shares = [total // shards + (s < total % shards) for s in range(shards)]

    copies = nodes.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = scratch.write(copies, "copies")
    place = F.col("row").bitwiseAND(F.lit((1 << _PLACE) - 1))
    numbered = nodes.join(F.broadcast(starts), _partition(F.col("row")) == F.col("part")) \
        .withColumn("ordinal", F.col("start") + place).join(copies, "group", "left")
    narrow = scratch.write(numbered.select("row", "group", "copies",
                                           F.pmod("ordinal", F.lit(shards)).cast("int").alias("shard")), "numbered")
    linked = narrow.where("copies is not null")
    first = linked.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("rows"))
    blocks = propagate(first, shares, scratch, rounds)

    # a group's rows in order, dealt to its blocks: at most one block a shard
    piece = F.pmod(F.xxhash64("row"), F.ceil(F.col("copies") / PART)).cast("int").alias("piece")
    pieces = linked.select("row", "group", piece)
    piece_sizes = pieces.groupBy("group", "piece").agg(F.count(F.lit(1)).alias("n")) \
        .select("group", "piece", (F.sum("n").over(Window.partitionBy("group").orderBy("piece")) - F.col("n")).alias("before"))
    in_piece = F.row_number().over(Window.partitionBy("group", "piece").orderBy("row"))
    bounds = blocks.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("shard", "rows"))).alias("blocks")) \
        .withColumn("blocks", F.expr("""transform(blocks, (b, i) -> named_struct('shard', b.shard, 'upto',
            aggregate(slice(blocks, 1, i + 1), 0L, (t, c) -> t + c.rows)))"""))
    of_group = pieces.withColumn("in_piece", in_piece).join(piece_sizes, ["group", "piece"]).join(bounds, "group") \
        .select("row", F.expr("element_at(filter(blocks, b -> b.upto >= before + in_piece), 1).shard").alias("shard"))

    # documents without a link, in order, up to the shares
    loads = dict(blocks.groupBy("shard").agg(F.sum("rows")).collect())  # one row a shard
    upto, bound = 0, []
    for s in range(shards):
        upto += shares[s] - loads.get(s, 0)
        bound.append(upto)
    single = narrow.where("copies is null").select("row", _partition(F.col("row")).alias("part"))
    before = single.groupBy("part").agg(F.count(F.lit(1)).alias("n")) \
        .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a task
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("row"))
    filler = F.coalesce(*[F.when(F.col("rank") <= b, s) for s, b in enumerate(bound)])
    of_none = single.join(F.broadcast(before), "part").withColumn("rank", rank).select("row", filler.cast("int").alias("shard"))

    placed = scratch.write(of_group.unionByName(of_none).withColumn("part", _partition(F.col("row"))), "placed")
    offsets = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")) \
        .select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    slot = F.col("before") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    slots = placed.join(F.broadcast(offsets), ["shard", "part"]).select("row", "shard", slot.cast("long").alias("slot"))
    out = nodes.drop("group").join(slots, "row").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    out = scratch.write(out, "result")
    scratch.keep_only("result")
    return out


def cut_edges(placed: DataFrame, group: str = "group", shard: str = "shard") -> DataFrame:
    """One row: pairs of linked rows, and those of them in different shards."""
    blocks = placed.groupBy(group, shard).agg(F.count(F.lit(1)).cast("decimal(20,0)").alias("n")) \
        .groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    return blocks.agg(F.sum(F.expr("(n * n - n) / 2")).cast("decimal(38,0)").alias("edges"),
                      F.sum(F.expr("(n * n - inside) / 2")).cast("decimal(38,0)").alias("cut"))
