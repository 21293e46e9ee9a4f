"""Sharding by balanced label propagation under capacity quotas, then exact row counts."""

from __future__ import annotations

from itertools import accumulate, count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARDS = 40
#: Rows that one ranking window holds on average.
RANKED = 2000
#: Shares into which the rows of one text are dealt where they meet its first row.
SALTS = 32


def equal_texts(rows: DataFrame) -> DataFrame:
    """Links `a, b` between rows of one `group`: each row to the group's first row."""
    first = rows.groupBy("group").agg(F.min("row").alias("b"), F.count("*").alias("n")).filter("n > 1").select("group", "b")
    return salted(rows, "row").join(copied(first), ["group", "salt"]).filter("row <> b").select(F.col("row").alias("a"), "b")


def salted(rows: DataFrame, by: str) -> DataFrame:
    """`rows` with a `salt` by column `by`, so that a hot key is dealt to SALTS tasks."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))


def copied(keys: DataFrame) -> DataFrame:
    """One row for each salt, of keys that are met by `salted` rows."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def propagate(scratch: Scratch, labels: DataFrame, links: DataFrame, shards: int, rows: int) -> DataFrame:
    """`row, shard` of the linked rows after moves towards the commonest shard of their smaller neighbours.

    A row looks only at neighbours of smaller number, so no two rows change places and each comes to
    rest once those before it have; rounds go on until no shard with room is asked for. A shard has room for linked rows up to the even share, as the last step moves unlinked ones away; of the rows that want in, those of the smallest
    hashes go, so the share that may go is all that the driver has to know: one number a shard.
    """
    down = scratch.table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"))
    heads = scratch.table(down.select("b").distinct())
    near = down.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    cap = rows // shards
    now = scratch.table(near.join(labels.select("row", "shard"), "row"))
    for turn in count():
        led = copied(heads.join(now.select(F.col("row").alias("b"), "shard"), "b"))
        seen = salted(down, "a").join(led, ["b", "salt"]).groupBy(F.col("a").alias("row"), "shard").agg(F.count("*").alias("n"))
        want = seen.groupBy("row").agg(F.max(F.struct("n", (-F.col("shard")).alias("to"))).alias("best"), F.sum("n").alias("of"))
        own = seen.select("row", "shard", F.col("n").alias("mine"))
        moves = now.join(want, "row", "left").join(own, ["row", "shard"], "left")
        chance = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(1_000_000)) / 1_000_000
        moves = moves.select("row", "shard", (-F.col("best.to")).alias("to"), (F.col("best.n") > F.coalesce("mine", F.lit(0))).alias("better"), chance.alias("chance"))
        moves = scratch.table(moves.withColumn("to", F.when(F.coalesce("better", F.lit(False)), F.col("to")).otherwise(F.col("shard"))))
        size = dict(moves.groupBy("shard").count().collect())
        asked = dict(moves.filter("to <> shard").groupBy("to").count().collect())
        if not any(size.get(s, 0) < cap for s in asked):
            scratch.drop(moves)
            return now
        share = [min(1.0, max(0.0, (cap - size.get(s, 0)) / asked[s])) if s in asked else 0.0 for s in range(shards)]
        admit = F.get(F.array(*[F.lit(x) for x in share]), F.col("to"))
        scratch.drop(now)
        now = scratch.table(moves.select("row", F.when(F.col("chance") < admit, F.col("to")).otherwise(F.col("shard")).alias("shard")))
        scratch.drop(moves)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: `doc_id, size, text_crc32, law, shard, slot, grown_shard`; shards' counts are at most one apart.

    Links join rows of equal texts; null texts are not linked. Rows start in the shard of their hash,
    linked ones move by `propagate`, and rows above a shard's even share, unlinked ones first, go to
    shards below it. Slots are gapless from 0. A group larger than a shard is spread over several.
    """
    scratch = Scratch(docs.sparkSession)
    raw = F.encode("text", "UTF-8")
    text = F.coalesce(raw, F.encode(F.lit(""), "UTF-8"))
    rows = scratch.table(
        docs.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            (F.length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text").alias("h"), F.crc32(raw).alias("c"), F.length(raw).alias("n"))).alias("group"),
        ).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    )
    total = rows.count()
    links = scratch.table(equal_texts(rows.filter("group is not null").select("row", "group")))
    moved = propagate(scratch, rows, links, shards, total)
    placed = rows.drop("group").join(moved.select("row", F.col("shard").alias("to")), "row", "left")
    buckets = max(8, total // (shards * RANKED))
    # linked rows take the first ranks of a shard, so the surplus is unlinked as far as it can be
    placed = scratch.table(placed.select(
        "doc_id", "row", "size", "text_crc32", F.coalesce("to", "shard").cast("int").alias("shard"),
        (F.pmod(F.xxhash64("row", F.lit(7)), F.lit(buckets)) + F.when(F.col("to").isNull(), F.lit(buckets)).otherwise(F.lit(0))).alias("bucket"),
    ))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")) - 1)
    ranked = ranked.join(before, ["shard", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))

    held = dict(placed.groupBy("shard").count().collect())
    goal = [total // shards + (s < total % shards) for s in range(shards)]
    over = [max(0, held.get(s, 0) - goal[s]) for s in range(shards)]
    under = [max(0, goal[s] - held.get(s, 0)) for s in range(shards)]
    over_before, under_before = [0, *accumulate(over)][:-1], [0, *accumulate(under)]
    numbers = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    goals, firsts = numbers(goal), numbers(over_before)
    surplus = F.when(F.col("rank") >= F.get(goals, F.col("shard")), F.get(firsts, F.col("shard")) + F.col("rank") - F.get(goals, F.col("shard")))
    target, slot = F.col("shard"), F.col("rank")
    for s in range(shards):
        if under[s]:
            inside = (F.col("surplus") >= under_before[s]) & (F.col("surplus") < under_before[s + 1])
            target = F.when(inside, F.lit(s)).otherwise(target)
            slot = F.when(inside, F.col("surplus") - under_before[s] + held.get(s, 0)).otherwise(slot)
    out = ranked.withColumn("surplus", surplus).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), target.cast("int").alias("shard"), slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return scratch.finish(out)
