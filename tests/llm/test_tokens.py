"""Tokenizers in worker processes."""

import numpy as np
import public_tokenizers

from emberlog.llm import quality, tokens


def test_special_strings_are_those_of_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokens.WordMemoTokenizer(path)
    name = t.special[0]
    texts = [f"plain a{name}b 12{name}", None, "x-1 y-2 déjà-vu, 3.5"]
    out = [np.frombuffer(x, "<u4").tolist() for x in t.encode(texts)]
    t.tokenizer.encode_special_tokens = False
    assert out == [t.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_quality_drops_the_tokenizers_of_its_worker():
    """Packing leaves a tokenizer in a worker that goes on to quality rules, in a pipeline that is run again."""
    tokens.loaded(tokens.WordMemoTokenizer, public_tokenizers.path("word_bpe_49k.json"))
    quality.forget()
    assert not tokens._loaded
