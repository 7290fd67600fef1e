"""Perplexity against the textbook's model, one gram at a time; fences and verdicts by brute force; scripts and awkward tables."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import perplexity, q_perplexity
from tidebook.llm.common import table

SF = "/root/testdata/sf0.001"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(120)]


def prose(n, r, words=VOCABULARY):
    return " ".join(r.choice(words) for _ in range(n))


def brute_model(texts):
    """The bits of each text by the textbook."""
    order = perplexity.ORDER
    pad = lambda t: "\0" * (order - 1) + t.replace("\0", "�")
    count = {order: Counter(pad(t)[i : i + order] for t in texts for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in count[k + 1])
    off, total, given = {}, defaultdict(float), defaultdict(float)
    for k in count:
        m = Counter(x if x < 5 else 9 for x in count[k].values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] and m[2] else 0.5
        ratio = lambda a, b: m[a] / m[b] if m[b] else 0.0  # noqa: B023, E731
        off[k] = [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * ratio(2, 1)), (2, 2 - 3 * y * ratio(3, 2)), (3, 3 - 4 * y * ratio(4, 3)))]
        for g, c in count[k].items():
            total[k, g[:-1]] += c
            given[k, g[:-1]] += off[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if not g:
            return 1 / perplexity.UNITS
        t, c = total[k, g[:-1]], count[k].get(g, 0)
        return (((c - off[k][min(c, 3) - 1]) if c else 0.0) + given[k, g[:-1]] * p(g[1:])) / t if t else p(g[1:])

    return lambda t: float(np.mean([-math.log2(p(pad(t)[i : i + order])) for i in range(len(t))])) if t else None


def test_bits_are_the_textbooks(spark):
    texts = [prose(60, random.Random(i)) for i in range(12)] + ["Ünï 12, (x)! \n\n#* a\0b", "", "漢字かな交じり文 漢字", "\U0001f600 x"]
    model = perplexity.train(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"))
    want = brute_model(texts)
    seen = [*texts[:3], "zq Zq 99 never seen!", "#", "", "漢字 ж\0", texts[0]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*seen, None])], "i int, text string").repartition(3)
    got = {r["i"]: r["bits"] for r in perplexity.perplexity(rows, model).collect()}
    assert len(got) == len(seen) + 1 and got[len(seen)] is None
    for i, t in enumerate(seen):
        assert got[i] == pytest.approx(want(t), rel=1e-9) if t else got[i] is None


def test_probabilities_of_all_code_points_add_up_to_one(spark):
    texts = [prose(30, random.Random(i)) for i in range(5)]
    model = perplexity.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    letters = sorted(set("".join(texts)))
    contexts = ("abc", "\0\0\0", texts[0][:3], texts[1][4:7])
    asked = spark.createDataFrame([(c + x,) for c in contexts for x in [*letters, "漢"]], "gram string")
    p = {r["gram"]: 2 ** -r["bits"] for r in perplexity.gram_bits(asked, model).collect()}
    for c in contexts:
        unseen = perplexity.UNITS - len(letters)
        assert sum(p[c + x] for x in letters) + unseen * p[c + "漢"] == pytest.approx(1.0, rel=1e-6)


def test_fences_and_verdicts_are_those_of_brute_force(spark):
    r = random.Random(4)
    rows = [(i, prose(r.choice([3, 12, 60, 300]), r), r.choice(["en", "en", "fr", None])) for i in range(400)]
    rows += [(1000 + i, "".join(random.Random(i).choice("#$%*QXZ0 ") for _ in range(r.choice([20, 400]))), "en") for i in range(20)] + [(2000, None, None), (2001, "", "xx"), (5, rows[5][1], rows[5][2])]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(3, 0), (None, 1), (1001, 0)], "doc_id long, quality int")
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = perplexity.judge(d, labels, quantile=0.9).collect()
    assert len(got) == len(rows)
    held = {x["doc_id"] for x in d.select("doc_id").filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) == 0).collect()}
    trusted = {i for i in range(300) if i % 4 > 0}
    want = brute_model([t for i, t, _ in rows if i in trusted - held])
    band = lambda t: sum(len(t) >= x for x in (64, 256, 1024))
    cells = defaultdict(list)
    for i, t, lang in rows:
        if i in trusted & held:
            for key in ((lang, band(t)), ("*", band(t)), (lang, "*"), ("*", "*")):
                cells[key].append(want(t))
    quantile = lambda v: sorted(v)[math.ceil(0.9 * len(v)) - 1]

    def fence(lang, t):
        for key, n in (((lang, band(t)), 30), (("*", band(t)), 10), ((lang, "*"), 10)):
            if key[0] is not None and len(cells[key]) >= n:
                return quantile(cells[key])
        return quantile(cells["*", "*"])

    for x in got:
        t = x["text"] or ""
        if not t:
            assert x["trusted_like"]
            continue
        assert x["bits"] == pytest.approx(want(t), rel=1e-9) and x["fence"] == pytest.approx(fence(x["lang"], t), rel=1e-9)
        assert x["trusted_like"] == (x["bits"] <= x["fence"])
    assert not any(x["trusted_like"] for x in got if 1000 <= x["doc_id"] < 1100)


def test_scripts_are_told_apart(spark):
    """Held-out Russian and Chinese prose passes, the same letters shuffled do not."""
    r = random.Random(8)
    russian = ["".join(r.choice("абвгдежзиклмнопрстуы") for _ in range(r.randint(2, 7))) for _ in range(80)]
    chinese = ["".join(chr(0x4E00 + r.randrange(400)) for _ in range(r.randint(1, 3))) for _ in range(80)]
    rows, bad = [], []
    for i in range(400):
        words, glue, lang = (russian, " ", "ru") if i % 2 else (chinese, "", "zh")
        t = glue.join(r.choice(words) for _ in range(150))
        rows.append((i, t, lang))
        if i >= 340:
            bad.append((i + 1000, "".join(r.sample(t, len(t))), lang))
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    got = {x["doc_id"]: x["trusted_like"] for x in perplexity.judge(spark.createDataFrame([*rows, *bad], "doc_id long, text string, lang string"), labels).collect()}
    assert not any(got[i] for i, _, _ in bad) and sum(got[i] for i in range(300, 400)) >= 90


def test_shards_cut_a_task_without_changing_bits(spark, monkeypatch):
    texts = [prose(40, random.Random(i)) for i in range(30)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    model = perplexity.train(d.select("text").limit(15))
    whole = {r["i"]: r["bits"] for r in perplexity.perplexity(d, model).collect()}
    monkeypatch.setattr(perplexity, "SHARD", 700)
    monkeypatch.setattr(perplexity, "CHUNK", 300)
    assert perplexity.in_shards(d).select("_shard").distinct().count() > 5
    assert {r["i"]: r["bits"] for r in perplexity.perplexity(d, model).collect()} == pytest.approx(whole)


def test_awkward_tables(spark):
    long = prose(150_000, random.Random(1))
    rows = [(1, None, None), (None, "a b c d e f", "en"), (2, "", "en"), (3, " \t\n", "en"), (4, long, "en"), (5, "x", "xx"), (5, "x", "xx"), (7, "idiot \\ ünï \U0001f600 \x00", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("own") for c in ("bits", "fence", "trusted_like", "_shard", "band", "gram")})
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4, 5)], "doc_id long, quality int")
    got = perplexity.judge(odd, labels)
    assert got.count() == len(rows) and {"band", "gram"} <= set(got.columns)
    assert perplexity.judge(odd, labels.limit(0)).filter("trusted_like").count() == len(rows)
    assert perplexity.judge(odd.limit(0), labels).count() == 0


def test_query_gives_its_columns(spark):
    got = q_perplexity.op4_quality_classifier(spark, SF)
    assert got.columns == ["doc_id", "lang", "bits", "perplexity", "fence", "kept"]
    rows = got.collect()
    assert len(rows) == table(spark, SF, "documents").count() and sum(r["kept"] for r in rows) > 0.7 * len(rows)
