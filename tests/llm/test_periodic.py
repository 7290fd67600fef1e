"""Runs of words against brute force: made sequences, the whole query, and awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from tidebook.llm import periodic, q_periodic
from tidebook.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(words, least_length=6, exponent=4):
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_length, exponent * q) and not any(words[i : j + q - p] == words[i + p : j + q] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_brute_force(letters):
    r = random.Random(letters)
    for _ in range(500):
        words = []
        while len(words) < r.randint(0, 70):
            words += [r.randrange(letters) for _ in range(r.randint(1, 5))] * r.choice([1, 1, 3, 4, 6])
        for exponent in (3, 4, 5):
            assert periodic.runs(words, 6, exponent) == brute(words, 6, exponent)


def test_meetings_are_the_longest_common_suffixes():
    r = random.Random(8)
    for _ in range(200):
        w = [r.randrange(2) for _ in range(r.randint(1, 25))]
        for i, j, s in periodic.last_meetings(*periodic.suffix_links(w)):
            common = next((k for k in range(j + 1) if w[i - k] != w[j - k]), j + 1)
            assert j < i and s == common > 0


def test_exponents_that_could_hide_are_refused():
    with pytest.raises(ValueError):
        periodic.runs([1, 1], 6, 2)


def test_long_texts():
    assert periodic.runs(["ab"] * 300_000) == [(0, 300_000, 1)]
    assert periodic.runs([f"w{i % 1000}" for i in range(100_000)]) == [(0, 100_000, 1000)]
    assert periodic.runs([f"w{i}" for i in range(100_000)]) == []


def test_awkward_rows(spark):
    rows = [(1, None, 1, "c"), (2, "", 1, "c"), (3, " \n ", 1, "c"), (4, "x y " * 4, 1, "c"), (4, "x y " * 4, 1, "c"), (5, "x y " * 6, 1, "c"), (None, "a a a a a", 1, "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    got = sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(d).collect())
    assert got == [(0, [], "a a a a a"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 8, 2)], "x y"), (4, [(0, 8, 2)], "x y"), (5, [(0, 6, 1)], "x y")]
    assert periodic.find_runs(d.limit(0)).count() == 0


def wanted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(kept)))


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in q_periodic.op13_periodic_runs(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    some = [i for i, t in texts.items() if len(t or "") < 20_000]
    assert len(some) > 190 and any(got[i][0] for i in some)
    assert {i: got[i] for i in some} == {i: wanted(i, texts[i]) for i in some}
