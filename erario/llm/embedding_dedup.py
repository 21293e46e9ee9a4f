"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank with the vectors.

A rotation learned on a bounded sample turns each vector into a binary code. Tables index every code
by some of its bits; vectors that share a bucket and whose codes are near are compared by cosine in
double precision. Vectors within half the angle of one leader are a unit: all of them are linked with
each other by the triangle inequality, so a large group of copies is neither expanded nor indexed once
for each member. What a unit's members link with outside it is counted block by block, not as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

#: Rows that the rotation is learned from at most, and rounds of learning it.
FIT_ROWS, FIT_ROUNDS = 8192, 50
#: Most bits of a code.
BITS = 256
#: Bits of a bucket's key up to BASE_ROWS rows (one more for each factor of 4), and the share of pairs
#: just at the threshold that the tables have to bring together.
WIDTH, BASE_ROWS, RECALL = 12, 1 << 20, 0.97
#: Bits and tables of the search for leaders, and its rounds.
LEAD_WIDTH, LEAD_TABLES, LEAD_ROUNDS = 24, 12, 3
#: Units of a bucket, and vectors of a block, that one task compares at a time.
CHUNK, BLOCK = 4096, 256


def table_count(width: int, threshold: float, recall: float = RECALL) -> int:
    """Tables of `width` bits that bring together the wanted share of pairs at the threshold."""
    same = (1 - math.acos(threshold) / math.pi) ** width
    return math.ceil(math.log(1 - recall) / math.log(1 - same)) if same < 1 else 1


def bit_sets(bits: int, width: int, tables: int, seed: int) -> np.ndarray:
    """Bits of each table: disjoint runs of random orders of all bits."""
    rng, found = np.random.default_rng(seed), []
    while len(found) < tables:
        order = rng.permutation(bits)
        found += [order[i : i + width] for i in range(0, bits - width + 1, width)]
    return np.array(found[:tables])


def learn(sample: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Projection (dimensions x bits) of unit vectors whose signs are the code.

    Principal axes about the origin, as cosine is about the origin, then a rotation that is fitted in
    turn to the signs it gives (orthogonal Procrustes).
    """
    _, _, axes = np.linalg.svd(sample.T @ sample)
    axes = axes[: min(BITS, sample.shape[1])].T
    flat = sample @ axes
    turn = np.linalg.qr(np.random.default_rng(11).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = w.T @ u.T
    return axes @ turn


def units_of(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that squares stay finite."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def words_of(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint64).reshape(len(codes), -1)


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all codes of `a` with all of `b`."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def masks_of(sets: np.ndarray, words: int) -> np.ndarray:
    masks = np.zeros((len(sets), words * 64), np.uint8)
    np.put_along_axis(masks, sets, 1, 1)
    return np.packbits(masks, axis=1, bitorder="little").view(np.uint64)


def keys_of(codes: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Bucket of each code in each table, the table's number in the high bits."""
    bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
    powers = np.int64(1) << np.arange(sets.shape[1])
    return np.stack([bits[:, s] @ powers + (np.int64(t) << np.int64(sets.shape[1])) for t, s in enumerate(sets)], 1)


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """`function(batch)` gives a dict of arrays or lists for each Arrow batch, or an iterator of them."""
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        for batch in batches:
            if batch.num_rows:
                for out in function(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Sorted on both sides. Spark takes a table for as large as the files it comes from, also where each
    of their rows becomes many, and would collect one of a row for each vector on the driver to send it.
    A frequent key is split over tasks if both sides come from their own shuffles, so sums are stored first."""
    return left.join(right.hint("merge"), on, how)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def finite_rows(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values, in double precision, of the vectors of that length without null or non-finite entries."""
    if not pa.types.is_large_list(column.type):
        column = column.cast(pa.large_list(column.type.value_type))
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dimensions)
    values = column.filter(pa.array(sizes == dimensions)).flatten()
    x = values.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(len(at), dimensions)
    good = np.isfinite(x).all(1)
    return at[good], x[good]


def commonest_length(table: DataFrame, vector: str) -> int:
    """Length of most vectors, the smaller one of a tie; 0 without any."""
    found = table.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return found[0].n if found else 0


def usable(column: pa.Array, dimensions: int, kind: str) -> list[bytes | None]:
    """Raw bytes of each vector; None for one that is null, zero, of another length or not finite throughout."""
    out: list[bytes | None] = [None] * len(column)
    at, x = finite_rows(column, dimensions)
    for i, ok, v in zip(at.tolist(), (x != 0).any(1).tolist(), x.astype(kind)):
        if ok:
            out[i] = v.tobytes()
    return out


def _exploded(batch: pa.RecordBatch, sets: np.ndarray, **columns):
    keys = keys_of(words_of(batch.column("code").to_pylist()), sets)
    yield {"key": keys.ravel()} | {k: np.repeat(v, len(sets)) for k, v in columns.items()}


def _groups_of_sorted(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys of a stream sorted by them, one table for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([_numbers(batch, k) for k in keys], 1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(values)]
        for first, last in zip(cuts, cuts[1:]):
            if held and first == 0 and (np.array([held[0].column(k)[0].as_py() for k in keys]) != values[0]).any():
                yield pa.Table.from_batches(held)
                held = []
            elif held and first:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.Table.from_batches(held)


class _Search:
    """The tables of one run."""

    def __init__(self, scratch: Scratch, rows: DataFrame, kind: str, threshold: float, width: int, recall: float):
        self.scratch, self.rows, self.kind, self.threshold = scratch, rows, kind, threshold
        self.angle = math.acos(threshold)
        valid = rows.filter("raw is not null").select("row", "raw")
        sample = valid.select("raw", F.xxhash64("raw", "row").alias("h")).orderBy("h").limit(FIT_ROWS).collect()
        projection = learn(units_of([bytes(r.raw) for r in sample], kind))
        self.bits = projection.shape[1]
        self.words = -(-self.bits // 64)
        self.width = min(width, self.bits)
        self.sets = bit_sets(self.bits, self.width, table_count(self.width, threshold, recall), 23)
        words = self.words

        def encode(batch):
            x = units_of(batch.column("raw").to_pylist(), kind) @ projection >= 0
            packed = np.zeros((len(x), words * 8), np.uint8)
            packed[:, : -(-x.shape[1] // 8)] = np.packbits(x, axis=1, bitorder="little")
            yield {"row": _numbers(batch, "row"), "code": [c.tobytes() for c in packed]}

        self.codes = scratch.table(_mapped(valid, encode, "row bigint, code binary"))

    def leaders(self) -> DataFrame:
        """`row, unit, ucode`: rows within half the angle of a leader, which is their unit and has a row too.

        Rounds over the rows left: each bucket of many bits proposes its row of least hash. A leader has
        no nearer leader itself, so a unit is a star. Rows that no round places stay units of their own.
        """
        sets = bit_sets(self.bits, min(LEAD_WIDTH, self.bits), LEAD_TABLES, 29)
        kind, most, free, found = self.kind, 0.995 * self.angle / 2, self.codes, None
        for turn in range(LEAD_ROUNDS):
            spread = _mapped(free, lambda b: _exploded(b, sets, row=_numbers(b, "row"), code=np.array(b.column("code").to_pylist(), object)), "key bigint, row bigint, code binary")
            first = spread.groupBy("key").agg(F.min(F.struct(F.xxhash64("row", F.lit(turn)).alias("h"), "row", "code")).alias("c"), F.count("*").alias("n"))
            first = self.scratch.table(first.filter("n > 1").select("key", F.col("c.h").alias("h"), F.col("c.row").alias("unit"), F.col("c.code").alias("ucode")))
            pairs = _joined(spread.select("key", "row"), first, "key").filter("row <> unit").select("row", "unit", "ucode", "h").distinct()
            raw = self.rows.select("row", "raw")
            both = _joined(_joined(pairs, raw, "row"), raw.select(F.col("row").alias("unit"), F.col("raw").alias("uraw")), "unit")

            def near(batch):
                a, b = (units_of(batch.column(c).to_pylist(), kind) for c in ("raw", "uraw"))
                ok = np.arccos(np.clip((a * b).sum(1), -1, 1)) <= most
                yield {c: batch.column(c).filter(pa.array(ok)) for c in ("row", "unit", "ucode", "h")}

            close = self.scratch.table(_mapped(both, near, "row bigint, unit bigint, ucode binary, h bigint"))
            led = close.select(F.col("row").alias("unit"))
            kept = _joined(close, led, "unit", "left_anti").groupBy("row").agg(F.min(F.struct("h", "unit", "ucode")).alias("c")).select("row", "c.unit", "c.ucode")
            kept = self.scratch.table(kept)
            if not kept.limit(1).count():
                break
            found = kept if found is None else found.union(kept)
            done = kept.select("row").union(kept.select("unit")).distinct()
            free = self.scratch.table(_joined(free, done, "row", "left_anti"))
        if found is None:
            return self.rows.sparkSession.createDataFrame([], "row bigint, unit bigint, ucode binary")
        heads = found.select(F.col("unit").alias("row"), "unit", "ucode").dropDuplicates(["row"])
        return self.scratch.table(found.union(heads))

    def candidates(self, placed: DataFrame) -> DataFrame:
        """`a, b`: units with vectors in one bucket whose leaders' codes are near enough for a link."""
        sets, masks, words = self.sets, masks_of(self.sets, self.words), self.words
        share = self.angle / math.pi

        def limit(steps: float, deviations: float) -> float:
            p = min(0.5, share * steps)
            return self.bits * p + deviations * math.sqrt(self.bits * p * (1 - p))

        limits = np.array([limit(1, 4), limit(1.5, 3), limit(2, 3)])
        columns = "key bigint, unit bigint, big boolean, ucode binary"
        spread = lambda df: _mapped(
            df, lambda b: _exploded(b, sets, unit=_numbers(b, "unit"), big=_numbers(b, "big"), ucode=np.array(b.column("ucode").to_pylist(), object)), columns
        )
        entries = spread(placed.filter("not big")).union(spread(placed.filter("big")).dropDuplicates(["key", "unit"]))
        hot = self.scratch.table(entries.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK))
        if hot.limit(1).count():  # a large bucket is cut, and each pair of its parts is a task's group
            parts = F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1))
            cut = entries.join(hot, "key", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("unit"), "parts"))
            cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
            entries = cut.select("key", "unit", "big", "ucode", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
        else:
            zero = F.lit(0).cast("bigint")
            entries = entries.select("key", "unit", "big", "ucode", zero.alias("i"), zero.alias("j"), zero.alias("own"))
        width = self.width

        def compare(batches):
            target = pa.schema([("a", pa.int64()), ("b", pa.int64())])
            for group in _groups_of_sorted(batches, ["key", "i", "j"]):
                if group.num_rows < 2:
                    continue
                table = group.column("key")[0].as_py() >> width
                i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
                unit, own = group.column("unit").to_numpy(), group.column("own").to_numpy()
                big = group.column("big").to_numpy().astype(np.int64)
                codes = words_of(group.column("ucode").to_pylist())
                left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
                for start in range(0, len(left), 512):
                    rows = left[start : start + 512]
                    near = unlike(codes[rows], codes[right]) <= limits[big[rows, None] + big[None, right]]
                    x, y = np.nonzero(near)
                    x, y = rows[x], right[y]
                    if i == j:
                        x, y = x[x < y], y[x < y]
                    # a pair of single vectors comes out of its first bucket alone
                    differ = codes[x] ^ codes[y]
                    seen = np.zeros(len(x), bool)
                    for mask in masks[:table]:
                        seen |= ~(differ & mask).any(1)
                    fresh = ~seen | (big[x] + big[y] > 0)
                    a, b = unit[x[fresh]], unit[y[fresh]]
                    apart = a != b
                    a, b = a[apart], b[apart]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=target)

        order = ["key", "i", "j"]
        return entries.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a bigint, b bigint").distinct()

    def checked(self, pairs: DataFrame, placed: DataFrame) -> DataFrame:
        """`a, b, single`: links of single vectors, and pairs with a larger unit that their leaders allow."""
        lead = _joined(placed.filter("row = unit").select("row", "big"), self.rows.select("row", "raw"), "row")
        side = lambda x: lead.select(F.col("row").alias(x), F.col("raw").alias(f"raw_{x}"), F.col("big").cast("int").alias(f"big_{x}"))
        kind, angle, threshold = self.kind, self.angle, self.threshold

        def check(batch):
            x, y = (units_of(batch.column(f"raw_{c}").to_pylist(), kind) for c in "ab")
            cosine = (x * y).sum(1)
            big = _numbers(batch, "big_a") + _numbers(batch, "big_b")
            ok = np.where(big == 0, cosine >= threshold, np.arccos(np.clip(cosine, -1, 1)) <= (1 + 0.5 * big) * angle + 1e-6)
            yield {"a": _numbers(batch, "a")[ok], "b": _numbers(batch, "b")[ok], "single": big[ok] == 0}

        return self.scratch.table(_mapped(_joined(_joined(pairs, side("a"), "a"), side("b"), "b"), check, "a bigint, b bigint, single boolean"))

    def counted(self, open_: DataFrame, placed: DataFrame) -> DataFrame:
        """`row, n` of vectors linked across two units, and `a, b` of units with such a link.

        The vectors of the smaller unit are packed by the larger one; a task multiplies a pack with a
        block of the larger unit and gives one count for each vector, never the pairs.
        """
        sizes = self.scratch.table(placed.groupBy("unit").agg(F.count("*").alias("size")))
        size = lambda x: sizes.select(F.col("unit").alias(x), F.col("size").alias(f"size_{x}"))
        swap = (F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") > F.col("b")))
        pairs = _joined(_joined(open_, size("a"), "a"), size("b"), "b").select(
            F.when(swap, F.col("b")).otherwise(F.col("a")).alias("small"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("large"),
            F.least("size_a", "size_b").alias("n"), F.greatest("size_a", "size_b").alias("size"),
        )
        pairs = self.scratch.table(pairs)
        packs = pairs.groupBy("large").agg(F.ceil(F.sum("n") / BLOCK).alias("packs"))
        vectors = _joined(placed.select("row", "unit"), self.rows.select("row", "raw"), "row")
        asked = _joined(_joined(pairs, packs, "large"), vectors.withColumnRenamed("unit", "small"), "small")
        asked = asked.groupBy("large", F.pmod(F.xxhash64("row", "small"), "packs").alias("pack")).agg(F.collect_list(F.struct("small", "row", "raw")).alias("queries"))
        blocks = _joined(vectors, self.scratch.table(pairs.select(F.col("large").alias("unit"), "size").distinct()), "unit")
        blocks = blocks.withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / BLOCK)))
        # dealt by block: the joins leave a large unit in one task
        blocks = blocks.repartition("unit", "block").groupBy("unit", "block").agg(F.collect_list(F.struct("row", "raw")).alias("held"))
        kind, threshold = self.kind, self.threshold

        def multiply(batch):
            for i in range(batch.num_rows):
                asked, held, large = batch.column("queries")[i].values, batch.column("held")[i].values, batch.column("large")[i].as_py()
                linked = units_of(asked.field("raw").to_pylist(), kind) @ units_of(held.field("raw").to_pylist(), kind).T >= threshold
                across, down = linked.sum(1), linked.sum(0)
                units = np.unique(asked.field("small").to_numpy()[across > 0])
                rows = np.concatenate([asked.field("row").to_numpy()[across > 0], held.field("row").to_numpy()[down > 0]])
                empty = [None] * len(units)
                yield {
                    "row": [*rows.tolist(), *empty], "n": [*across[across > 0].tolist(), *down[down > 0].tolist(), *empty],
                    "a": [None] * len(rows) + units.tolist(), "b": [None] * len(rows) + [large] * len(units),
                }

        both = _joined(asked, blocks.withColumnRenamed("unit", "large"), "large").select("large", "queries", "held")
        return self.scratch.table(_mapped(both, multiply, "row bigint, n bigint, a bigint, b bigint"))


def near_vectors(table: DataFrame, threshold: float = 0.9, *, vector: str = "embedding", name: str = "vec_id", width: int | None = None, recall: float = RECALL) -> DataFrame:
    """Per row of `table`: `vec_id, n_links, component_id, kept`.

    Vectors whose cosine is `threshold` or more are linked. `component_id` is the smallest id reachable;
    a row without an id belongs to its component but does not name it, and without a named row it is
    null. Vectors that are null, zero, not finite, or of another length than the commonest one are linked
    with nothing. Equal vectors are linked; rows that share an id are separate rows. `kept` is true
    where both ids are equal. An empty table gives no row. Every link given is exact; `recall` is the
    share of links exactly at the threshold that the tables find, nearer ones are found more often.
    """
    scratch = Scratch(table.sparkSession)
    kind = "<f4" if table.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    source = table.select(F.col(name).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    dimensions = commonest_length(table, vector)

    def keep(batch):
        yield {"row": batch.column("row"), "vec_id": batch.column("vec_id"), "raw": usable(batch.column("v"), dimensions, kind)}

    rows = scratch.table(_mapped(source, keep, "row bigint, vec_id bigint, raw binary"))
    total = rows.filter("raw is not null").count()
    alone = lambda df: df.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not total:
        return scratch.finish(alone(rows))
    if width is None:
        width = WIDTH + max(0, math.ceil(math.log(total / BASE_ROWS, 4)))
    search = _Search(scratch, rows, kind, threshold, width, recall)
    led = search.leaders()
    own = _joined(search.codes, led, "row", "left")
    placed = scratch.table(own.select("row", F.coalesce("unit", "row").alias("unit"), "code", F.coalesce("ucode", "code").alias("ucode"), F.col("unit").isNotNull().alias("big")))
    pairs = search.checked(search.candidates(placed), placed)
    found = search.counted(pairs.filter("not single").select("a", "b"), placed)

    single = pairs.filter("single")
    counts = single.select(F.explode(F.array("a", "b")).alias("row"), F.lit(1).cast("bigint").alias("n")).union(found.filter("row is not null").select("row", "n"))
    counts = counts.groupBy("row").agg(F.sum("n").alias("outside"))
    edges = single.select("a", "b").union(found.filter("row is null").select("a", "b")).distinct()
    labels = components(scratch, edges, "merge")
    units = _joined(placed.select("row", "unit"), rows.select("row", "vec_id"), "row").groupBy("unit").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
    units = scratch.table(_joined(units, labels.withColumnRenamed("node", "unit"), "unit", "left").withColumn("label", F.coalesce("label", "unit")))
    heads = scratch.table(units.groupBy("label").agg(F.min("least").alias("component_id")))
    units = _joined(units, heads, "label").select("unit", "size", "component_id")
    linked = _joined(_joined(_joined(placed.select("row", "unit"), units, "unit"), counts, "row", "left"), rows.select("row", "vec_id"), "row")
    linked = linked.select(
        "vec_id", (F.col("size") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
    return scratch.finish(linked.union(alone(rows.filter("raw is null"))))
