"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, stars.

Texts with equal shingle sets are one class. Classes that share a bucket are candidates. Each bucket
first gives star-shaped edges from its most central class; the edges are confirmed on full sets and
joined to components. Pairs that a star can miss, those of one bucket that lie in different
components, are then compared inside tasks, block by block: a row is sent for each class and block,
never for a pair, and a block gives no more links than it has classes. Counts of shared shingles and
the marks of the bins, both exact bounds, spare most comparisons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordArray, components, map_batches, runs_hash
from .embedding_dedup import _groups_of_sorted

BANDS, ROWS, SHINGLE = 32, 4, 5
BINS = BANDS * ROWS
#: Classes of one block.
BLOCK = 1024
#: Bins that an empty bin asks, in this order, until one is filled.
_ASK = np.random.default_rng(20170806).integers(0, BINS, (BINS, 4096), dtype=np.int16)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def shingle_set(text: bytes | None, known: WordArray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; a shorter text is one shingle."""
    words = known.of((text or b"").lower())
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(runs_hash(words, min(SHINGLE, len(words))) + np.uint64(len(words) * (len(words) < SHINGLE)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin; an empty bin takes that of the first filled bin it asks."""
    at = np.searchsorted(shingles, _EDGES)
    ends = np.append(at[1:], len(shingles))
    filled = at < ends
    out = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    for columns in (slice(0, 32), slice(32, None)):
        if len(empty):
            hit = filled[_ASK[empty, columns]]
            first = hit.argmax(1)
            ok = hit.any(1)
            out[empty[ok]] = out[_ASK[empty[ok], first[ok] + (columns.start or 0)]]
            empty = empty[~ok]
    out[empty] = shingles[0]  # has a chance below 1e-13 for one filled bin, and is the same in both sets
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    keys = signature(shingles).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for r in range(ROWS):
        h = (h ^ keys[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def bin_marks(shingles: np.ndarray) -> np.ndarray:
    """One byte of each bin's least hash, 0 for an empty bin, eight bins in a number.

    A bin whose marks differ in two sets holds a shingle that only one of them has.
    """
    at = np.searchsorted(shingles, _EDGES)
    filled = at < np.append(at[1:], len(shingles))
    least = shingles[np.minimum(at, len(shingles) - 1)]
    return np.where(filled, least % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).view(np.int64)


def _describe(c, known):
    sets = [shingle_set(t, known) for t in c["text"]]
    return {
        "doc_id": c["doc_id"],
        "row": c["row"],
        "textkey": c["textkey"],
        "n": [len(s) for s in sets],
        "class": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
        "bands": [band_keys(s) if len(s) else None for s in sets],
        "marks": [bin_marks(s) if len(s) else None for s in sets],
    }


def _sets(c, known):
    sets = [shingle_set(t, known) for t in c["text"]]
    return {"class": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]}


def _explode(c, _):
    sets = [np.frombuffer(s, np.int64) for s in c["shingles"]]
    ids = [k for k, s in zip(c["class"], sets) for _ in range(len(s))]
    return {"class": ids, "shingle": np.concatenate(sets)}


def _confirm(percent: int):
    def run(c, _):
        a, b = [], []
        for x, y, s, t in zip(c["a"], c["b"], c["set_a"], c["set_b"]):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            at = np.minimum(np.searchsorted(s, t), len(s) - 1)
            both = int((s[at] == t).sum())
            if 100 * both >= percent * (len(s) + len(t) - both):
                a.append(x)
                b.append(y)
        return {"a": a, "b": b}

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    s = sets.select("class", "shingles")
    both = pairs.join(s.select(F.col("class").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = both.join(s.select(F.col("class").alias("b"), F.col("shingles").alias("set_b")), "b")
    return map_batches(both.select("a", "b", "set_a", "set_b"), _confirm(percent), "a binary, b binary")


class _Block:
    """Classes whose pairs a task compares, and the components that links have joined so far."""

    def __init__(self, rows: pa.Table, percent: int):
        column = lambda name: rows.column(name).combine_chunks()
        self.percent, self.names = percent, column("class").to_pylist()
        self.own, self.n, self.common = (column(c).to_numpy() for c in ("own", "n", "common"))
        flat = lambda name: column(name).flatten().to_numpy().reshape(rows.num_rows, -1)
        self.bands, self.marks = flat("bands"), np.ascontiguousarray(flat("marks")).view(np.uint8)
        self.sets = [np.frombuffer(s, np.uint64) for s in column("shingles").to_pylist()]
        known = {}
        self.label = np.array([known.setdefault(x, len(known)) for x in column("label").to_pylist()])
        self.parent = list(range(len(known)))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def candidates(self, i: int, j: int):
        """Pairs of one bucket in different components that the bounds leave possible."""
        left, right = np.flatnonzero(self.own == i), np.flatnonzero(self.own == j)
        for start in range(0, len(left), 128):
            x = left[start : start + 128]
            near = np.zeros((len(x), len(right)), bool)
            for band in range(self.bands.shape[1]):
                near |= self.bands[x, band, None] == self.bands[None, right, band]
            most = np.minimum(self.common[x, None], self.common[None, right])
            near &= 100 * most >= self.percent * (self.n[x, None] + self.n[None, right] - most)
            near &= self.label[x, None] != self.label[None, right]
            a, b = np.nonzero(near)
            a, b = x[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            for s in range(0, len(a), 1 << 15):
                p, q = a[s : s + (1 << 15)], b[s : s + (1 << 15)]
                # a bin whose marks are unlike holds a shingle that only one of both sets has
                unlike = (self.marks[p] != self.marks[q]).sum(1)
                ok = (100 - self.percent) * (self.n[p] + self.n[q]) >= (100 + self.percent) * unlike
                yield from zip(p[ok].tolist(), q[ok].tolist())

    def links(self, i: int, j: int):
        """A link for each join of two components."""
        for a, b in self.candidates(i, j):
            x, y = self.root(self.label[a]), self.root(self.label[b])
            if x == y:
                continue
            s, t = self.sets[a], self.sets[b]
            both = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())
            if 100 * both >= self.percent * (len(s) + len(t) - both):
                self.parent[x] = y
                yield self.names[a], self.names[b]


def _compare(percent: int):
    def run(batches):
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        for rows in _groups_of_sorted(batches, ["g", "i", "j"]):
            i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
            found = list(_Block(rows, percent).links(i, j))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], schema=schema)

    return run


def _missed(own: Scratch, members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links `a, b` between components that share a bucket; None without such buckets.

    Buckets that share a class are one group, so that each class is sent once for each block of its
    group, whatever the number of its buckets.
    """
    labelled = members.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    labelled = own.table(labelled.select("bucket", "class", "n", "common", "label"))
    open_ = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("class").alias("b")).filter("x <> y")
    inside = own.table(labelled.join(open_.select("bucket", "b"), "bucket"))
    if not inside.limit(1).count():
        return None
    groups = components(own, inside.filter(F.col("class") != F.col("b")).select(F.col("class").alias("a"), "b"))
    one = inside.select("class", "n", "common", "label").dropDuplicates(["class"])
    placed = own.table(one.join(groups.select(F.col("node").alias("class"), F.xxhash64("label").alias("g")), "class"))
    parts = placed.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = placed.join(parts, "g").withColumn("own", F.pmod(F.xxhash64("class"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    dealt = dealt.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "n", "common", "label")
    whole = dealt.join(classes.select("class", "bands", "marks"), "class").join(sets.select("class", "shingles"), "class")
    order = ["g", "i", "j"]
    return own.table(whole.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compare(percent), "a binary, b binary"))


def _possible(percent: int):
    """No pair beyond this bound is a link: shared shingles of either side bound the intersection."""
    most = F.least("common_a", "common_b")
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


def groups(docs: DataFrame, percent: int = 80, scratch: Scratch | None = None, row: str | None = None) -> DataFrame:
    """Per document: `doc_id, n_shingles, component_id, kept, textkey`.

    Documents are linked if `100 * |intersection| >= percent * |union|` of their shingle sets;
    `component_id` is the smallest doc_id reachable. A null, empty or blank text has no shingle and is
    linked with nothing. Rows with a null doc_id belong to their component but do not name it; without
    a named row it is null. Rows that share a doc_id are separate rows. `kept` is true where
    doc_id and component_id are the same. With `row`, a column of `docs` that numbers its rows, that
    number and the group's own `label`, null without shingles, come as `row` and `label` too.
    """
    own = scratch or Scratch(docs.sparkSession)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("textkey"), (F.col(row) if row else F.lit(None).cast("long")).alias("row"))
    rows = own.table(map_batches(texts, _describe, "doc_id bigint, row bigint, textkey bigint, n bigint, class binary, bands array<bigint>, marks array<bigint>", WordArray))
    classes = own.table(
        rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.min(F.struct("textkey", "bands", "marks")).alias("one"))
        .select("class", "least", "one.textkey", "one.bands", "one.marks")
    )
    spread = classes.select("class", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    buckets = own.table(spread.join(shared, "bucket"))

    wanted = own.table(buckets.groupBy("class").agg(F.sum("members").alias("weight")).join(classes.select("class", "textkey"), "class"))
    # the hint keeps one plan at every size, so that figures of small tables tell those of large ones
    kept_texts = texts.select("textkey", "text").join(wanted.select("textkey").distinct().hint("merge"), "textkey", "left_semi").dropDuplicates(["textkey"]).select("text")
    sets = own.table(map_batches(kept_texts, _sets, "class binary, n bigint, shingles binary", WordArray))

    shingles = map_batches(sets.select("class", "shingles"), _explode, "class binary, shingle bigint", rows=200)
    common = shingles.groupBy("shingle").agg(F.count("*").alias("k")).filter("k > 1").select("shingle")
    counts = shingles.join(common, "shingle").groupBy("class").agg(F.count("*").alias("common"))
    able = own.table(
        counts.join(sets.select("class", "n"), "class").filter(100 * F.col("common") >= percent * F.col("n"))
        .join(wanted.select("class", "weight"), "class").select("class", "n", "common", "weight")
    )
    members = own.table(buckets.select("bucket", "class").join(able, "class"))

    b = members.select("bucket", *[F.col(x).alias(f"{x}_b" if x != "class" else "b") for x in ("class", "n", "common")])
    # the centre: the class with the largest share of common shingles, then the most company
    centre = members.groupBy("bucket").agg(
        F.max(F.struct(F.expr("common / n").alias("share"), "weight", "class", "n", "common")).alias("c"), F.count("*").alias("m")
    ).filter("m > 1").select("bucket", F.col("c.class").alias("a"), F.col("c.n").alias("n_a"), F.col("c.common").alias("common_a"))
    star = centre.join(b, "bucket").filter(F.col("a") != F.col("b")).filter(_possible(percent))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    first = own.table(star.select(*ordered).distinct())
    links = own.table(_linked(first, sets, percent))
    labels = components(own, links)

    more = _missed(own, members, labels, classes, sets, percent)
    # a link to the least class of each component stands for the links that made it
    joined = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    named = labels if more is None or not more.limit(1).count() else components(own, joined.union(more))

    least = classes.select("class", "least").join(named.select(F.col("node").alias("class"), "label"), "class", "left")
    least = least.select("class", F.coalesce("label", "class").alias("label"), "least")
    heads = least.groupBy("label").agg(F.min("least").alias("component_id"))
    of = least.join(heads, "label").select("class", "component_id", "label")
    out = rows.select("doc_id", "row", "textkey", F.col("n").alias("n_shingles"), "class").join(of, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "textkey", *(["row", "label"] if row else []))
    return own.finish(out)


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group, that of the smallest doc_id; all columns stay.

    Rows without shingles stay. Rows of one group that share its smallest doc_id or have none: one stays.
    """
    # stored, as numbers drawn again over fewer columns may differ
    numbered = Scratch(docs.sparkSession).table(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = groups(numbered, percent, row="_row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    heads = found.filter("label is not null").groupBy("label").agg(F.min(order)["row"].alias("_row")).select("_row")
    stay = heads.union(found.filter("label is null").select("row"))
    return numbered.join(stay, "_row", "left_semi").select(*docs.columns)
