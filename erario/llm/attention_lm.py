"""LM scoring: a causal self-attention model on subword ids beside a smoothed unigram base.

The model gives `P(class | context) * P(id | class)`: attention predicts the frequency class of the
next id, counts over all training ids share the class out. Windows of two blocks overlap by one: a
block's tokens attend to the block before and to their own past, and each token is scored once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordArray, map_batches, mixed, rank_encoding

BLOCK, WIDTH, CLASSES, BUCKETS, OWN = 16, 16, 32, 1024, 512
#: Words whose counts every task holds; the counts of all others are joined.
FREQUENT = 100_000
#: Groups in which tasks' parameters are averaged before the driver averages the groups.
GROUPS = 32
VOCABULARY = 1 << 16
#: Stands for the end of a text among its ids; the tokenizer's own are smaller.
END_ID = VOCABULARY - 1
#: Stands for the end of a text among the words' hashes.
END_WORD = np.uint64(0x5EED0FAB1E5EED01)
SHAPES = {
    "E": (BUCKETS, WIDTH), "Wq": (WIDTH, WIDTH), "Wk": (WIDTH, WIDTH), "Wv": (WIDTH, WIDTH), "Wr": (WIDTH, WIDTH),
    "M": (BLOCK, 2 * BLOCK), "c": (WIDTH,), "Wo": (WIDTH, CLASSES), "bo": (CLASSES,),
}
#: Where each array begins and ends in `flat` weights.
_ENDS = np.cumsum([0, *(int(np.prod(s)) for s in SHAPES.values())]).tolist()
#: Blocks worked on at a time; their arrays fit a core's cache.
PART = 128
#: Exponents below this in size need no maximum taken off.
TAME = 60
#: Columns of a token's projections: query, rest, key, value; behind the value stands a 1, which sums weights.
_Q, _R, _K, _V = (slice(i * WIDTH, (i + 1) * WIDTH) for i in range(4))
_KV, _V1 = slice(2 * WIDTH, 4 * WIDTH), slice(3 * WIDTH, 4 * WIDTH + 1)
_SEEN = np.arange(2 * BLOCK)[None] <= np.arange(BLOCK)[:, None] + BLOCK


def start_weights(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.2, s) if len(s) > 1 and k != "M" else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def shaped(x: np.ndarray) -> dict[str, np.ndarray]:
    return {k: x[a:b].reshape(s) for (k, s), a, b in zip(SHAPES.items(), _ENDS, _ENDS[1:])}


class Classes:
    """Frequency classes of equal mass, input buckets, and log10 of each id's share of its class."""

    def __init__(self, counts: np.ndarray):
        mass = counts + 1.0
        order = np.argsort(-mass, kind="stable")
        middle = np.cumsum(mass[order]) - mass[order] / 2
        self.of = np.empty(len(counts), np.int64)
        self.of[order] = np.minimum(middle * CLASSES / mass.sum(), CLASSES - 1).astype(np.int64)
        self.share = np.log10(mass / np.bincount(self.of, mass, CLASSES)[self.of])
        ids = np.arange(len(counts), dtype=np.uint64)
        self.bucket = (OWN + 1 + (mixed(ids) % np.uint64(BUCKETS - OWN - 1))).astype(np.int64)
        self.bucket[order[:OWN]] = np.arange(1, OWN + 1)  # bucket 0 is the start of a text


def blocks_of(texts: list[np.ndarray], classes: Classes) -> tuple[np.ndarray, ...]:
    """Inputs, targets, ids (each blocks x BLOCK, targets -1 beyond a text's end), first-block flags, text of each block."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // BLOCK)
    total = int(counts.sum())
    ids, targets, inputs = np.zeros(total * BLOCK, np.int64), np.full(total * BLOCK, -1), np.zeros(total * BLOCK, np.int64)
    first = np.zeros(total, bool)
    if total:
        every = np.concatenate(texts)
        starts = np.cumsum(counts) - counts
        at = np.arange(len(every)) + np.repeat(starts * BLOCK - (np.cumsum(sizes) - sizes), sizes)
        ids[at], targets[at] = every, classes.of[every]
        follows = at[1:] == at[:-1] + 1
        follows[np.cumsum(sizes[sizes > 0])[:-1] - 1] = False
        inputs[at[1:][follows]] = classes.bucket[every[:-1][follows]]
        first[starts[sizes > 0]] = True
    shape = (-1, BLOCK)
    return inputs.reshape(shape), targets.reshape(shape), ids.reshape(shape), first, np.repeat(np.arange(len(texts)), counts)


def _pairs(rows: np.ndarray) -> np.ndarray:
    """Each block's rows behind those of the block before, as views."""
    a, b, c = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (len(rows) - 1, 2 * BLOCK, rows.shape[2]), (a, b, c))


class Attention:
    """Class chances of up to PART blocks in a row, in arrays that are kept.

    Arrays made anew for every batch can cost as much, in memory mapped and cleared, as the arithmetic on them.
    Tokens are projected by bucket, and blocks that follow each other share their keys and values.
    """

    def __init__(self, dtype: type = np.float32):
        def room(*shape):
            return np.empty(shape, dtype)

        self.table, self.ones = np.ones((BUCKETS, 4 * WIDTH + 1), dtype), np.ones(PART * BLOCK, dtype)
        self.p = room(PART + 1, BLOCK, 4 * WIDTH + 1)
        self.k, self.v = _pairs(self.p[..., _K]), _pairs(self.p[..., _V1])
        self.s, self.sums = room(PART, BLOCK, 2 * BLOCK), room(PART, BLOCK, WIDTH + 1)
        self.o, self.h, self.z = room(PART, BLOCK, WIDTH), room(PART, BLOCK, WIDTH), room(PART * BLOCK, CLASSES)

    def load(self, w: dict[str, np.ndarray]) -> Attention:
        self.w = w
        self.projection = np.hstack([w["Wq"] * w["Wq"].dtype.type(WIDTH**-0.5), w["Wr"], w["Wk"], w["Wv"]])
        np.matmul(w["E"], self.projection, out=self.table[:, : 4 * WIDTH])
        self.table[:, _R] += w["c"]
        longest = lambda x: float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))
        self.tame = longest(self.table[:, _Q]) * longest(self.table[:, _K]) + float(np.abs(w["M"]).max()) < TAME
        self.tame_out = float((np.abs(w["Wo"]).sum(0) + np.abs(w["bo"])).max()) < TAME
        self.gate = np.where(_SEEN, np.exp(w["M"]), 0).astype(w["M"].dtype) if self.tame else None
        return self

    def chances(self, chain: np.ndarray, first: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, ...]:
        """Classes' chances (rows x CLASSES) up to a factor, their sums, the picked ones' cells and log-probabilities.

        `chain` has the block before the first one and the blocks.
        """
        m = len(first)
        p, s, sums, o, h, z = self.p[: m + 1], self.s[:m], self.sums[:m], self.o[:m], self.h[:m], self.z[: m * BLOCK]
        np.take(self.table, chain, 0, out=p, mode="clip")
        np.matmul(p[1:, :, _Q], self.k[:m].transpose(0, 2, 1), out=s)
        if self.tame:
            np.exp(s, out=s)
            s *= self.gate
            s[first, :, :BLOCK] = 0
        else:
            s += self.w["M"]
            s[:, ~_SEEN] = -np.inf
            s[first, :, :BLOCK] = -np.inf
            s -= s.max(2, keepdims=True)
            np.exp(s, out=s)
        np.matmul(s, self.v[:m], out=sums)
        np.divide(sums[..., :WIDTH], sums[..., WIDTH:], out=o)
        np.add(o, p[1:, :, _R], out=h)
        np.tanh(h, out=h)
        np.matmul(h.reshape(-1, WIDTH), self.w["Wo"], out=z)
        z += self.w["bo"]
        if not self.tame_out:
            z -= z.max(1, keepdims=True)
        cells = np.arange(0, z.size, CLASSES) + picks
        logs = z.reshape(-1)[cells]
        np.exp(z, out=z)
        total = z @ self.ones[:CLASSES]
        logs -= np.log(total)
        return z, total, cells, logs


class Gradient(Attention):
    """The way back through `chances`, for batches of up to `batch` blocks."""

    def __init__(self, batch: int, dtype: type = np.float32):
        super().__init__(dtype)

        def room(*shape):
            return np.empty(shape, dtype)

        self.dh, self.back, self.ds = room(PART * BLOCK, WIDTH), room(PART, BLOCK, WIDTH + 1), room(PART, BLOCK, 2 * BLOCK)
        self.dkv, self.d = room(PART, 2 * BLOCK, 2 * WIDTH), room(batch + 1, BLOCK, 4 * WIDTH)
        self.u, self.du = room((batch + 1) * BLOCK, WIDTH), room(WIDTH, (batch + 1) * BLOCK)

    def of(self, w, inputs, before, first, targets) -> tuple[float, dict[str, np.ndarray]]:
        self.load(w)
        dtype = w["E"].dtype
        valid = targets.ravel() >= 0
        shares = (valid / max(int(valid.sum()), 1)).astype(dtype)
        picks = np.maximum(targets.ravel(), 0)
        chain = np.concatenate([before[:1], inputs])
        g = {k: np.zeros(SHAPES[k], dtype) for k in ("M", "c", "Wo", "bo")}
        loss, every = 0.0, self.d[: len(chain)]
        every[:1] = 0
        for i in range(0, len(inputs), PART):
            part, m = slice(i * BLOCK, (i + PART) * BLOCK), len(first[i : i + PART])
            z, total, cells, logs = self.chances(chain[i : i + m + 1], first[i : i + m], picks[part])
            share, one = shares[part], self.ones[: m * BLOCK]
            loss -= float(logs @ share)
            z *= (share / total)[:, None]
            z.reshape(-1)[cells] -= share
            h = self.h[:m].reshape(-1, WIDTH)
            g["Wo"] += h.T @ z
            g["bo"] += one @ z
            dh = np.matmul(z, w["Wo"].T, out=self.dh[: m * BLOCK])
            h *= h
            np.subtract(1, h, out=h)
            dh *= h
            g["c"] += one @ dh
            d, back, s, ds, dkv, sums = every[i : i + m + 1], self.back[:m], self.s[:m], self.ds[:m], self.dkv[:m], self.sums[:m, :, WIDTH:]
            d[1:, :, _R] = dh.reshape(m, BLOCK, WIDTH)
            np.divide(d[1:, :, _R], sums, out=back[..., :WIDTH])
            dh *= self.o[:m].reshape(-1, WIDTH)
            back[..., WIDTH:] = (dh @ self.ones[:WIDTH]).reshape(m, BLOCK, 1) / -sums
            np.matmul(back, self.v[:m].transpose(0, 2, 1), out=ds)
            ds *= s
            g["M"] += (one[:m] @ ds.reshape(m, -1)).reshape(BLOCK, -1)
            np.matmul(ds, self.k[:m], out=d[1:, :, _Q])
            np.matmul(ds.transpose(0, 2, 1), self.p[1 : m + 1, :, _Q], out=dkv[..., :WIDTH])
            np.matmul(s.transpose(0, 2, 1), back[..., :WIDTH], out=dkv[..., WIDTH:])
            d[1:, :, _KV] = dkv[:, BLOCK:]
            d[:-1, :, _KV] += dkv[:, :BLOCK]
        every, buckets = every.reshape(-1, 4 * WIDTH), chain.ravel()
        both = np.take(w["E"], buckets, 0, out=self.u[: len(buckets)], mode="clip").T @ every
        du = np.matmul(self.projection, every.T, out=self.du[:, : len(buckets)])
        g["E"] = np.stack([np.bincount(buckets, x, BUCKETS) for x in du], 1).astype(dtype)
        g["Wq"], g["Wr"], g["Wk"], g["Wv"] = both[:, _Q] * dtype.type(WIDTH**-0.5), both[:, _R], both[:, _K], both[:, _V]
        return loss, g


def gradient(w, inputs, before, first, targets) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss in nats and its gradient over the valid targets; `before` is as `shifted` gives it."""
    return Gradient(len(inputs), w["E"].dtype).of(w, inputs, before, first, targets)


class Learner:
    """Adam over the training blocks of one task."""

    def __init__(self, weights: np.ndarray, batch: int = 256, rate: float = 0.01):
        self.w, self.batch, self.rate = weights.copy(), batch, rate
        self.m, self.v, self.t, self.blocks = np.zeros_like(weights), np.zeros_like(weights), 0, 0
        self.gradient = Gradient(batch)

    def learn(self, inputs, before, first, targets) -> None:
        for i in range(0, len(inputs), self.batch):
            part = slice(i, i + self.batch)
            _, g = self.gradient.of(shaped(self.w), inputs[part], before[part], first[part], targets[part])
            g = flat(g)
            self.t += 1
            self.m += 0.1 * (g - self.m)
            self.v += 0.01 * (g * g - self.v)
            self.w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)
            self.blocks += len(inputs[part])


def shifted(inputs: np.ndarray) -> np.ndarray:
    """Each block's block before; that of a text's first block is masked by its flag."""
    return np.concatenate([inputs[:1], inputs[:-1]]) if len(inputs) else inputs


def tokenized(rows: DataFrame, path: str) -> DataFrame:
    """`row, held_out, ids`; ids are below VOCABULARY, take two bytes each and end with END_ID."""

    def run(c, _):
        e = rank_encoding(path)
        ids = [np.array([*e.encode_ordinary((t or b"").decode("utf-8", "replace")), END_ID], "<u2").tobytes() for t in c["text"]]
        return {"row": c["row"], "held_out": c["held_out"], "ids": ids}

    return map_batches(rows.select("row", "held_out", "text"), run, "row bigint, held_out boolean, ids binary")


def _ids(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(r, "<u2").astype(np.int64) for r in raw]


def _words(texts: list[bytes | None], known: WordArray) -> list[np.ndarray]:
    return [np.append(known.of((t or b"").lower()), END_WORD) for t in texts]


def counted(train: DataFrame) -> DataFrame:
    """`key, n` of the hashed words of all training texts."""

    def run(c, known):
        w, n = np.unique(np.concatenate(_words(c["text"], known)).view(np.int64), return_counts=True)
        return {"key": w, "n": n}

    return map_batches(train.select("text"), run, "key bigint, n bigint", WordArray, rows=10_000).groupBy("key").agg(F.sum("n").alias("n"))


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs; the driver gets at most the vocabulary."""

    def run(c, _):
        n = np.bincount(np.concatenate(_ids(c["ids"])), minlength=1)
        return {"id": np.flatnonzero(n), "n": n[n > 0]}

    out = np.zeros(VOCABULARY)
    for r in map_batches(tokens.select("ids"), run, "id bigint, n bigint", rows=10_000).groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def trained(train: DataFrame, classes: Classes) -> np.ndarray:
    """Weights averaged over tasks, each by its blocks; every task starts alike and learns from every block of its texts."""
    sent = train.sparkSession.sparkContext.broadcast((flat(start_weights()), classes))

    def learn(batches):
        import pyarrow as pa

        weights, classes = sent.value
        learner = Learner(weights)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                inputs, targets, _, first, _ = blocks_of(_ids(batch.column(0).slice(i, 500).to_pylist()), classes)
                learner.learn(inputs, shifted(inputs), first, targets)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([learner.w.tobytes()]), "blocks": pa.array([learner.blocks], pa.int64())})

    def average(batches):
        import pyarrow as pa

        total, blocks = np.zeros(len(sent.value[0])), 0
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, blocks = total + n * np.frombuffer(w, np.float32), blocks + n
        if blocks:
            yield pa.RecordBatch.from_pydict({"weights": pa.array([(total / blocks).astype(np.float32).tobytes()]), "blocks": pa.array([blocks], pa.int64())})

    schema = "weights binary, blocks bigint"
    each = train.select("ids").mapInArrow(learn, schema)
    groups = each.repartition(GROUPS).mapInArrow(average, schema).collect()
    n = sum(g["blocks"] for g in groups)
    if not n:
        return sent.value[0]
    return sum(np.frombuffer(g["weights"], np.float32).astype(np.float64) * (g["blocks"] / n) for g in groups).astype(np.float32)


def log10_scores(texts: list[np.ndarray], weights: dict[str, np.ndarray], classes: Classes) -> np.ndarray:
    """log10 probability of each text's ids."""
    inputs, targets, ids, first, of = blocks_of(texts, classes)
    chain, goal = np.concatenate([inputs[:1], inputs]), targets.ravel()
    picks, p = np.maximum(goal, 0), np.empty(len(goal))
    attention = Attention().load(weights)
    for i in range(0, len(inputs), PART):
        part = slice(i * BLOCK, (i + PART) * BLOCK)
        p[part] = attention.chances(chain[i : i + PART + 1], first[i : i + PART], picks[part])[-1]
    p = p / np.log(10) + classes.share[ids.ravel()]
    p[goal < 0] = 0
    return np.bincount(of, p.reshape(-1, BLOCK).sum(1), len(texts))


def score(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row: `doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`.

    Rows whose crc32 of the doc_id as text is 2 modulo 7 are held out, all others train; a row without a
    doc_id trains. Both the base and the model score the end of a text as one more token; null is the
    empty text, so it is that end alone. Without any training row every count is 0. Repeated rows count
    as often as they occur.
    """
    scratch = Scratch(docs.sparkSession)
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2, F.lit(False))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), held.alias("held_out"))
    tokens = scratch.table(tokenized(rows, tokenizer))
    words = scratch.table(counted(rows.filter("not held_out")))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = words.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    keys = np.array([r["key"] for r in top], np.int64)
    order = np.argsort(keys)
    train = tokens.filter("not held_out")
    classes = Classes(id_counts(train))
    spark = docs.sparkSession.sparkContext
    model = spark.broadcast((shaped(trained(train, classes)), classes))
    frequent = spark.broadcast((keys[order], np.log10(np.array([r["n"] for r in top], float)[order] + 1)))

    def model_scores(c, _):
        return {"row": c["row"], "score": log10_scores(_ids(c["ids"]), *model.value)}

    def run(c, known):
        keys, logs = frequent.value
        words = _words(c["text"], known)
        sizes = np.array([len(w) for w in words])
        h = np.concatenate(words).view(np.int64)
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        of = np.repeat(np.arange(len(words)), sizes)
        return {
            "row": c["row"], "doc_id": c["doc_id"], "held_out": c["held_out"], "n_tokens": sizes,
            "found": np.bincount(of, hit, len(words)).astype(np.int64),
            "logs": np.bincount(of, np.where(hit, logs[at] if len(keys) else 0.0, 0.0), len(words)),
            "rare": np.split(h[~hit], np.cumsum(np.bincount(of[~hit], minlength=len(words)))[:-1]),
        }

    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, found bigint, logs double, rare array<bigint>"
    scored = scratch.table(map_batches(rows, run, schema, WordArray, rows=500))
    rare = scored.select("row", F.explode("rare").alias("key")).join(words, "key").groupBy("row").agg(
        F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs")
    )
    below = float(np.log10(total + distinct + 1))
    scores = map_batches(tokens.select("row", "ids"), model_scores, "row bigint, score double", rows=500)
    out = scored.drop("rare").join(rare, "row", "left").join(scores, "row").select(
        "doc_id", "held_out", "n_tokens", (F.col("found") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"), "score",
    )
    return scratch.finish(out)
