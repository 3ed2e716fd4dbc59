"""Token ids against the library, on texts made of odd fragments."""

import random

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadenza.llm.tokens import Encoder

#: White space of every kind, added tokens, contractions, digits, marks and letters that change length
#: when they are normalised.
FRAGMENTS = [
    "a", "b", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x00", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2009", "\u200b", "\u2028", "\u202f", "\u3000", "\ufeff",
    "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "|", "<", "'s", "'ll", "don't", "0", "10", " 0 ", "\u00bd", "\u0663", "e\u0301", "\u0301", "\u00e9", "\u0130", "\u00df", "\u03a3", "\u0345", "\u01c5", "\u212a",
    "\uac00", "\u1100", "\u1161", "\u6f22\u5b57", "\U0001f600", "\U0001f469\u200d\U0001f467", "...", "#", "THE", "word", "www.x.org/",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    rng = random.Random(11)
    texts = ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 14))) for _ in range(10_000)]
    coder, plain = Encoder(public_tokenizers.path(name), most=3000), Tokenizer.from_file(public_tokenizers.path(name))
    for k in range(0, len(texts), 500):
        some = texts[k : k + 500]
        ids, at = coder.encode(pa.array([*some, None]))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [*(e.ids for e in plain.encode_batch(some, add_special_tokens=False)), []]


def test_what_is_remembered_is_bounded():
    coder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), most=100)
    for k in range(50):
        coder.encode(pa.array([" ".join(f"w{k}x{i}" for i in range(60))]))
        assert len(coder.known) <= 160 and len(coder.old) <= 160
