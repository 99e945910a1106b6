"""The trie and what the encoder keeps, against the tokenizers library."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from tessellar.llm import bpe_trie

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    found = [t.encode(x, add_special_tokens=False).ids for x in texts]
    return [(len(i), " ".join(map(str, i)), t.decode(i, skip_special_tokens=False)) for i in found]


def test_words_of_earlier_chunks_are_not_encoded_again():
    enc, asked = bpe_trie.TextEncoder(PATH), []
    plain = enc.bpe.encode_words
    enc.bpe.encode_words = lambda words: plain(asked.append(set(words)) or asked[-1])
    texts = ["melody Straße it's 42 don't", "(melody) straße, it don t Melody-42 MELODY's straßen", "İstanbul ΣΑΣ. été", "ΣΑΣ i̇stanbul été's"]
    got = [next(iter(enc.encode([t]))) for t in texts]
    assert got == library(texts)
    assert not {"melody"} & set().union(*asked[1:]) and "straßen" in asked[1]


def test_words_that_begin_alike():
    rng = random.Random(4)
    words = ["".join(rng.choices("abenéßж", k=rng.randint(1, 9))) for _ in range(3000)]
    words += [w[:k] for w in words[:300] for k in range(1, len(w))] + ["a", "aa", "aaa", "a" * 40, "a" * 41, "a" * 40 + "b"]
    texts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    assert list(bpe_trie.TextEncoder(PATH).encode(texts)) == library(texts)


def test_memory_that_is_cleared(monkeypatch):
    monkeypatch.setattr(bpe_trie, "KEPT", 4)
    enc, texts = bpe_trie.TextEncoder(PATH), [f"common w{k} common. x{k}y <|endoftext|> z" for k in range(20)]
    assert [next(iter(enc.encode([t]))) for t in texts] == library(texts)
