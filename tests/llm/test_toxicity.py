"""Toxicity against a brute-force cosine over whole vocabularies, held-out labels and awkward tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import q_toxicity, toxicity
from tidebook.llm.common import table

SF = "/root/testdata/sf0.001"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n, r):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def labelled(spark, n=300):
    r = random.Random(6)
    rows = [(i, prose(60, r) + (" " + " ".join(r.choice(["idiotword", "moronword", "scumword"]) for _ in range(3)) if i % 5 == 0 else "")) for i in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d, d.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))


def words(text):
    return Counter(re.findall(r"\w+", (text or "").lower()))


def brute(texts, examples):
    """For a text: its cosines with all examples, and its vote, word by word over raw texts."""
    df = Counter(w for t in texts for w in words(t))
    known = {w for t, _ in examples for w in words(t)}

    def vector(text):
        """All words of the text, whether an example has them or not."""
        v = {w: (1 + math.log(n)) * math.log((1 + len(texts)) / (1 + df[w])) for w, n in words(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    n = Counter(y for _, y in examples)
    have = {y: Counter(w for t, z in examples if z == y for w in words(t)) for y in (0, 1)}

    def tells(w):
        a, b, share = have[1][w] / n[1], have[0][w] / n[0], (have[1][w] + have[0][w]) / (n[0] + n[1])
        z = max(0.0, a - b) / math.sqrt(share * (1 - share) * (1 / n[1] + 1 / n[0]) + 1e-12)
        part = (min(1.0, z * z / (2 * math.log(len(known)))) * max(0.0, a - b) / (a + b)) ** 2
        return part if part >= 0.01 else 0.0

    telling, own = {w: tells(w) for w in known}, [vector(t) for t, _ in examples]

    def judged(text, k=16):
        v = vector(text)
        cosine = [sum(x * e.get(w, 0.0) for w, x in v.items()) for e in own]
        total, ones = 1.0, n[1] / (n[0] + n[1])
        for y in (0, 1):
            for i in sorted((i for i, (_, z) in enumerate(examples) if z == y and cosine[i] > 0), key=lambda i: -cosine[i])[:k]:
                told = sum(telling[w] ** 2 * x * own[i].get(w, 0.0) for w, x in v.items() if w in known)
                norm = math.sqrt(sum(telling[w] * x * x for w, x in v.items() if w in known) * sum(telling[w] * x * x for w, x in own[i].items()))
                w = max(told / norm if norm else 0.0, cosine[i] ** 4)
                total, ones = total + w, ones + w * y
        return sorted(cosine, reverse=True), ones / total

    return judged


def test_neighbours_and_votes_are_those_of_brute_force(spark):
    d, labels = labelled(spark)
    r = random.Random(7)
    odd = [(1000 + i, " ".join([*(f"unseen{r.randrange(30)}" for _ in range(i)), t])) for i, t in enumerate(["idiotword scumword", "never seen", "", *[prose(20, r) for _ in range(12)]])]
    d = d.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    model = toxicity.fit(d, labels.filter("doc_id < 1000"), F.lit(True))
    index, rows = model.index, d.orderBy("doc_id").collect()
    judged = brute([x["text"] for x in rows], [(x["text"], int(x["doc_id"] % 5 == 0)) for x in rows if x["doc_id"] < 1000])
    assert len(index.vocabulary) == len({w for x in rows if x["doc_id"] < 1000 for w in words(x["text"])})
    rest = {x["key"]: x["rest"] for x in model.rest.collect()}
    keys = {x["text"]: x["key"] for x in d.select("text", F.xxhash64("text").alias("key")).collect()}
    for text in [*(t for _, t in odd), *(x["text"] for x in rows[:25]), rows[0]["text"] + " idiotword the"]:
        vector = index.vector(*toxicity.hashed(text), rest[keys[text]] if text in keys else None)
        ((vote, near, cosine),) = index.votes([vector], 16)
        want, share = judged(text)
        for y in (0, 1):
            mine = sorted((c for p, c in zip(near, cosine, strict=True) if index.labels[p] == y), reverse=True)
            assert len(mine) == min(16, len(mine))
        assert sorted(cosine, reverse=True)[: min(16, len(cosine))] == pytest.approx([c for c in want if c > 0][: min(16, len(cosine))], rel=1e-4)
        assert vote == pytest.approx(share, rel=1e-3)


def test_unseen_words_lower_the_similarity(spark):
    d, labels = labelled(spark)
    three = "idiotword moronword scumword"
    long = three + " " + " ".join(f"unseen{i}" for i in range(500))
    d = d.unionByName(spark.createDataFrame([(2000, three), (2001, long)], "doc_id long, text string"))
    got = {r["doc_id"]: r["evidence"][0]["similarity"] for r in toxicity.score(d.filter("doc_id >= 2000"), toxicity.fit(d, labels.filter("doc_id < 1000"), F.lit(True))).collect()}
    assert got[2000] > 0.2 and got[2001] < got[2000] / 5


def test_pruned_blocks_hold_no_nearer_example():
    r = np.random.default_rng(3)
    size, vocabulary = 900, 400
    example = np.repeat(np.arange(size), 20)
    term = np.concatenate([np.sort(r.choice(vocabulary, 20, replace=False)) for _ in range(size)])
    idf = r.random(vocabulary) * 5
    index = toxicity.Index.build(np.arange(vocabulary), idf, np.zeros(vocabulary), r.integers(0, 2, size), np.arange(size), example, term, r.integers(1, 9, len(term)).astype(float), 16, long_share=0.05)
    dense = np.zeros((len(index.labels), vocabulary))
    for t in range(vocabulary):
        at = slice(index.term_at[t], index.term_at[t + 1])
        dense[index.place[at], t] = index.weight[at]
        if index.row[t] >= 0:
            assert at.start == at.stop
            dense[:, t] = index.full[index.row[t]].ravel()
    assert np.linalg.norm(dense[index.ids >= 0], axis=1) == pytest.approx(1.0, abs=1e-5) and 0 < len(index.full) < vocabulary
    vectors = [(t, r.random(len(t))) for t in (np.sort(r.choice(vocabulary, r.integers(1, 30), replace=False)) for _ in range(60))]
    for (t, q), (near, cosine) in zip(vectors, index.nearest(vectors, 8), strict=True):
        sims = dense[:, t] @ q
        for y in (0, 1):
            best = np.sort(sims[(index.labels == y) & (sims > 0)])[::-1][:8]
            assert cosine[index.labels[near] == y] == pytest.approx(best, rel=1e-5)


def test_copies_of_rare_toxic_wording_are_found(spark):
    """No word of the copied example occurs in another toxic one, so only the whole text tells."""
    d, labels = labelled(spark)
    odd = "zzugly qqvile xxnasty " + prose(40, random.Random(99))
    d = d.unionByName(spark.createDataFrame([(1000, odd), (2000, odd), (2001, odd + " and more")], "doc_id long, text string"))
    labels = labels.unionByName(spark.createDataFrame([(1000, 1)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(d.filter("doc_id >= 2000"), toxicity.fit(d, labels, F.lit(True))).collect()}
    assert all(r["score"] >= 0.3 and r["evidence"][0]["doc_id"] == 1000 for r in got.values())
    assert got[2000]["evidence"][0]["similarity"] > 0.999 and got[2001]["evidence"][0]["similarity"] > 0.8


def test_held_out_documents_are_told_apart(spark):
    d, labels = labelled(spark)
    model = toxicity.fit(d, labels, F.col("doc_id") < 200)
    got = toxicity.score(d.filter("doc_id >= 200"), model).collect()
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in got)
    assert all(any(e["label"] == 1 for e in r["evidence"]) for r in got if r["doc_id"] % 5 == 0)


def test_labels_held_out_are_never_read(spark):
    """Turning the held-out labels round changes no score."""
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels").select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(q_toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, x, ~q_toxicity.held_out())).collect()} for x in (labels, turned))
    assert a == b


def test_query_gives_its_columns(spark):
    got = q_toxicity.op10_toxicity(spark, SF)
    rows = got.collect()
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(rows) == table(spark, SF, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_awkward_tables(spark):
    d, labels = labelled(spark)
    rows = [(1, None), (None, "a b c d e f"), (2, ""), (3, " \t\n"), (4, prose(200_000, random.Random(1))), (5, "x"), (5, "x"), (7, "idiotword \x00 ünï \U0001f600")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("own"), "evidence": F.lit("own"), "label": F.lit(3)})
    out = toxicity.score(odd, toxicity.fit(d.unionByName(odd.select("doc_id", "text")), labels, F.lit(True)))
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["label"] == 3 for r in got)
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    none = toxicity.score(odd, toxicity.fit(odd, labels.limit(0), F.lit(True)))
    assert {r["score"] for r in none.collect()} == {0.0}
    assert toxicity.score(odd.limit(0), toxicity.fit(odd.limit(0), labels, F.lit(True))).count() == 0


def test_words_of_examples_are_hashed_once_by_a_worker(monkeypatch):
    """A text is read as its words' hashes say, and read again only words of no example are hashed."""
    texts = ["The CAT's_7 hat\x1f\x00 the", "Größe İx the ÜNÏ ٠١ hat", "lone \ud800 the Lone", "", " \t-"]
    all_words = sorted({w for t in texts for w in words(t)})
    mine = np.sort([toxicity.hashed(w)[0][0] for w in all_words[::2]])
    nothing = [np.zeros(0, np.int64)] * 4
    index, seen, plain = toxicity.Index.build(mine, np.ones(len(mine)), np.zeros(len(mine)), *nothing, np.zeros(0)), [], toxicity.hashes
    monkeypatch.setattr(toxicity, "hashes", lambda w: seen.extend(x if isinstance(x, str) else x.decode() for x in w) or plain(w))
    for _ in range(2):
        seen.clear()
        for text in texts:
            t, n, other, n_other = index.read(text)
            got = dict(zip([*mine[t].tolist(), *other.tolist()], [*n, *n_other], strict=True))
            assert got == {int(plain([w])[0]): k for w, k in words(text).items()}
            assert not set(mine.tolist()) & set(other.tolist())
    assert seen and not set(seen) & set(all_words[::2])
