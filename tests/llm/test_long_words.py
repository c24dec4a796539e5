"""BPE of very long words: equal to the library, with bounded tables."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vellumspark.llm import bpe


def test_a_long_word_is_equal_and_leaves_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 3000)
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    a, t = bpe.Automaton(path), Tokenizer.from_file(path)
    a.start()
    t.no_truncation()
    rng = random.Random(3)
    own = a.compiled
    for n in (65, 3000, 40_000):
        word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=n))
        for text in (word, f"a {word} b", word[:50]):
            assert np.frombuffer(a.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert len(a.states) <= own + 3000 + 2 and not any(len(w) > bpe.LONG for w in a.words)
