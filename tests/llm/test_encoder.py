"""A text's ids are made in one call, and are those of the vocabulary, special tokens and uneven white space among them."""

import pickle

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sibyl.llm import packing

TEXTS = ["", " ", "one two three one two", " a  b \n c\t", "x<|endoftext|>y <|endoftext|>", "Über naïve 東京 🙂", "a" * 3000]


def test_one_call_a_text():
    encoder, calls = packing.public_encoder(), []
    encoder.ids("warm")
    true = encoder._bpe

    class Counted:
        def __getattr__(self, name):
            return lambda *a, **k: calls.append(name) or getattr(true, name)(*a, **k)

    encoder._bpe = Counted()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in TEXTS:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(calls) == len(TEXTS) and pickle.loads(pickle.dumps(encoder))._bpe is None
