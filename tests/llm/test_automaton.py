"""The automaton's ids and texts against the tokenizers library; and a small set of merges by hand."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidebook.llm import q_automaton
from tidebook.llm.automaton import Automaton, compiled, decode, encode, encoder
from tidebook.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return np.frombuffer(encoder(compiled(PATH))(text), "<u4").tolist()


def merged(word, merges):
    """By the definition: the earliest merge first, from the left."""
    parts = list(word)
    for u, v, w in merges:
        k = 0
        while k + 1 < len(parts):
            if (parts[k], parts[k + 1]) == (u, v):
                parts[k : k + 2] = [w]
            k += 1
    return parts


def test_random_merges_as_defined():
    r = random.Random(2)
    for _ in range(60):
        label, merges = [b"a", b"b", b"c"], []
        for _ in range(12):
            u, v = r.randrange(len(label)), r.randrange(len(label))
            whole = label[u] + label[v]
            start = [label.index(bytes([x])) for x in whole]
            if label[u] + label[v] in label or merged(start, merges) != [u, v]:
                continue
            merges.append((u, v, len(label)))
            label.append(label[u] + label[v])
        walk = Automaton.compile(label, merges, {}).walker()
        for _ in range(200):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
            assert walk(word) == merged([label.index(bytes([x])) for x in word], merges)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_hard_words_as_the_library():
    r = random.Random(3)
    labels = [x for x in compiled(PATH).label if x]
    for k in range(3000):
        text = [b"".join(r.choice(labels) for _ in range(r.randint(1, 5))).decode("utf-8", "replace"), r.choice("ae-=* .0") * r.randint(1, 300), "".join(r.choice(["the", "in", "'s", "<|endoftext|>", " ", "ing", "est", "\n"]) for _ in range(9))][k % 3]
        assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids
        some = [r.randrange(50_257) for _ in range(6)]
        assert compiled(PATH).decode(some) == LIBRARY.decode(some, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 20_000, "ab" * 30_000, "中" * 20_000])
def test_very_long_words(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_rows_that_are_null_empty_repeated_or_wide(spark):
    rows = [(1, None, "x", 5), (2, "", "x", 6), (3, "so it is", "x", 7), (3, "so it is", "x", 7), (None, "so", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    found = decode(encode(d, PATH), PATH)
    got = sorted(((r["doc_id"] or 0, bytes(r["ids"]), r["decoded"]) for r in found.collect()))
    of = lambda t: np.array(LIBRARY.encode(t).ids, "<u4").tobytes()
    assert got == [(0, of("so"), "so"), (1, b"", ""), (2, b"", ""), (3, of("so it is"), "so it is"), (3, of("so it is"), "so it is")]
    assert decode(encode(d.limit(0), PATH), PATH).count() == 0
    odd = spark.createDataFrame([(None,), (bytearray(np.array([99_999_999, 13, 222], "<u4").tobytes()),)], "ids binary")
    assert sorted(r["decoded"] for r in decode(odd, PATH).collect()) == ["", LIBRARY.decode([13, 222], skip_special_tokens=False)]


def test_query_equals_the_library(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in q_automaton.op12_bpe_automaton(spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        x = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(b).hexdigest() for b in (np.array(x, "<u4").tobytes(), LIBRARY.decode(x, skip_special_tokens=False).encode())]
        assert got[r["doc_id"]] == (len(x), *digests)
