"""A literal added token has its own id, as a freshly loaded tokenizer file gives it."""

import numpy as np
from tokenizers import Tokenizer

from erario.llm import packing
from erario.llm.queries import tokenizer_path


def test_added_tokens_keep_their_id():
    fresh = Tokenizer.from_file(tokenizer_path())
    for ranks in (None, tokenizer_path("byte_bpe_50k.tiktoken")):
        for t in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "plain text", "<|endoftext", ""):
            ids = np.frombuffer(packing.Tokens(tokenizer_path(), ranks).ids(t), "<u4").tolist()
            assert ids == [*fresh.encode(t, add_special_tokens=False).ids, packing.END]
    assert 50256 in fresh.encode("a <|endoftext|> b", add_special_tokens=False).ids
