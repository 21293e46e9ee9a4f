"""op4's training keeps its arrays from batch to batch and gives the plain model's loss, gradient and scores."""

import tracemalloc

import numpy as np
import pytest

from erario.llm import attention_lm as lm


def plain_losses(w, inputs, first, targets):
    """Negative log-probabilities of the targets in nats, one block and place at a time."""
    out = np.zeros(targets.shape)
    for b in range(len(inputs)):
        rows = w["E"][np.concatenate([inputs[b - 1], inputs[b]])]
        for i in range(lm.BLOCK):
            seen = np.arange(lm.BLOCK if first[b] else 0, lm.BLOCK + i + 1)
            u = rows[lm.BLOCK + i]
            s = (rows[seen] @ w["Wk"]) @ (u @ w["Wq"]) / np.sqrt(lm.WIDTH) + w["M"][i, seen]
            a = np.exp(s - s.max())
            z = np.tanh(u @ w["Wr"] + (a / a.sum()) @ rows[seen] @ w["Wv"] + w["c"]) @ w["Wo"] + w["bo"]
            out[b, i] = z.max() + np.log(np.exp(z - z.max()).sum()) - z[targets[b, i]] if targets[b, i] >= 0 else 0
    return out


def sample(sizes, seed=0):
    rng = np.random.default_rng(seed)
    texts = [np.append(rng.integers(0, 3000, n), lm.END_ID) for n in sizes]
    return texts, lm.Classes(np.bincount(np.concatenate(texts), minlength=lm.VOCABULARY).astype(float))


@pytest.mark.parametrize("wild", [None, "Wq", "Wo", "M"])
def test_loss_gradient_and_scores(wild):
    texts, classes = sample((0, 15, 16, 40, 2300, 5))
    inputs, targets, ids, first, of = lm.blocks_of(texts, classes)
    assert len(inputs) > lm.PART  # more than one part
    rng = np.random.default_rng(1)
    w = {k: rng.normal(0, 0.3, s) for k, s in lm.SHAPES.items()}
    if wild:
        w[wild] *= 300
    plain = plain_losses(w, inputs, first, targets)
    loss, g = lm.gradient(w, inputs, lm.shifted(inputs), first, targets)
    assert loss == pytest.approx(plain.sum() / (targets >= 0).sum(), rel=1e-6)
    share = np.where(targets >= 0, classes.share[ids], 0)
    expected = np.bincount(of, (share - plain / np.log(10)).sum(1))
    f32 = {k: x.astype(np.float32) for k, x in w.items()}
    assert lm.log10_scores(texts, f32, classes) == pytest.approx(expected, rel=1e-4 if not wild else 2e-2)
    if not wild:
        bucket = int(inputs[3, 2])
        for k, at in (("E", (bucket, 3)), ("Wk", (1, 2)), ("Wv", (4, 0)), ("Wr", (5, 6)), ("Wq", (2, 2)), ("c", (3,)), ("bo", (7,)), ("M", (3, 9))):
            old, around = w[k][at], []
            for step in (1e-4, -1e-4):
                w[k][at] = old + step
                around.append(plain_losses(w, inputs, first, targets).sum() / (targets >= 0).sum())
            w[k][at] = old
            assert (around[0] - around[1]) / 2e-4 == pytest.approx(float(g[k][at]), rel=1e-3, abs=1e-8)


def test_batches_reuse_their_arrays():
    texts, classes = sample((9000, 9000))
    inputs, targets, _, first, _ = lm.blocks_of(texts, classes)
    learner = lm.Learner(lm.flat(lm.start_weights()))
    before = lm.shifted(inputs)
    learner.learn(inputs[:256], before[:256], first[:256], targets[:256])
    tracemalloc.start()
    try:
        learner.learn(inputs[256:], before[256:], first[256:], targets[256:])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2_000_000  # 10.2 MB before
