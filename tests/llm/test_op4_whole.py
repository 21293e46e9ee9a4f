"""op4 learns from every block of every training text, and the end of a text is scored."""

import numpy as np

from erario.llm import attention_lm
from erario.llm.queries import tokenizer_path


def test_every_block_is_learned_from(spark):
    texts = [np.append(np.random.default_rng(n).integers(0, 3000, n), attention_lm.END_ID) for n in (0, 5, 200, 700)]
    classes = attention_lm.Classes(np.bincount(np.concatenate(texts), minlength=attention_lm.VOCABULARY).astype(float))
    train = spark.createDataFrame([(t.astype("<u2").tobytes(),) for t in texts], "ids binary").coalesce(1)
    inputs, targets, _, first, _ = attention_lm.blocks_of(texts, classes)
    learner = attention_lm.Learner(attention_lm.flat(attention_lm.start_weights()))
    learner.learn(inputs, attention_lm.shifted(inputs), first, targets)
    assert learner.blocks == sum(-(-len(t) // attention_lm.BLOCK) for t in texts)
    assert np.allclose(attention_lm.trained(train, classes), learner.w, atol=1e-5)


def test_the_end_is_scored(spark):
    texts = ["", None, "one two three", "one two three four five"] * 5
    found = attention_lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path("byte_bpe_50k.tiktoken")).collect()
    assert len(found) == len(texts) and all(r["score"] < 0 for r in found)
