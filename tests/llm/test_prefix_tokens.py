import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from texloom.llm.prefix_tokens import PrefixCounter, chars_within, token_counts, tokens_of_prefix

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", " ", "  ", "\n", "'", "'re", "ll", "é", "中", "😀", "1", "2024", "!", "<|endoftext|>", "<|endof", "\x1c", "\x85", "\xa0", "\t", "-----", "ſ", "²"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_every_prefix(library):
    counter, rng = PrefixCounter(PATH), random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        counts = np.cumsum(counter.deltas(text), dtype=int).tolist()
        assert counts == [library(text[:i]) for i in range(1, len(text) + 1)], text


def test_one_very_long_word(library):
    rng = random.Random(5)
    text = "".join(rng.choice(["th", "e", "ing", "x", "é", "="]) for _ in range(5000))
    counter = PrefixCounter(PATH)
    assert counter.count(text) == library(text)
    deltas = counter.deltas(text).tobytes()
    for n in (1, 77, 3001):
        assert tokens_of_prefix(deltas, n) == library(text[:n])


def test_budget():
    counter = PrefixCounter(PATH)
    text = "one two  three, four"
    deltas = counter.deltas(text).tobytes()
    for budget in range(8):
        fits = [n for n in range(len(text) + 1) if tokens_of_prefix(deltas, n) <= budget]
        assert chars_within(deltas, budget) == max(fits)


def test_query_rows_equal_the_library(docs, library):
    for r in token_counts(docs, PATH, limit=200, keep=["doc_id", "text"], prefixes=True).collect():
        text = r["text"] or ""
        n = library(text)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 200)
        assert tokens_of_prefix(r["prefix_deltas"], len(text)) == n
        assert library(text[: r["chars_in_limit"]]) <= 200


def test_odd_rows(odd, none):
    rows = token_counts(odd.withColumn("N_TOKENS", F.lit(1)), PATH)
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows.collect()}
    assert rows.count() == 10 and found[2] == found[3] == (0, 0) and found[6][1] > 50_000
    assert token_counts(none, PATH).count() == 0
