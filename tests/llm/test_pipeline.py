"""Each stage's decisions against brute force, and queries whose rows SQL can't give."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_llm import brute_classes
from tidebook.llm import perplexity, q_dedup, q_media, q_mixing, q_packing, toxicity
from tidebook.llm.common import kept, table
from tidebook.llm.q_toxicity import held_out

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_toxic_and_poor_documents_go_and_no_others(spark, docs):
    model = toxicity.fit(docs, table(spark, SF, "labels").select("doc_id", "toxic"), ~held_out())
    bad = {r["doc_id"] for r in toxicity.score(docs.select("doc_id", "text"), model).filter("score >= 0.3").collect()}
    odd = docs.withColumns({"score": F.lit("own"), "bits": F.lit("own"), "evidence": F.lit(1)})
    out = corpus_pipeline.drop_toxic(spark, odd, SF)
    assert out.columns == odd.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in bad) and 0 < len(bad) < 40
    assert {r["score"] for r in out.collect()} == {"own"}
    good = {r["doc_id"] for r in perplexity.judge(docs.select("doc_id", "text", "lang"), table(spark, SF, "labels").select("doc_id", "quality")).filter("trusted_like").collect()}
    out = corpus_pipeline.drop_low_quality(spark, odd, SF)
    assert out.columns == odd.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] in good)


def test_one_document_of_each_class_stays(spark, docs):
    rows = docs.collect()
    classes = brute_classes([r["doc_id"] for r in rows], [r["text"] for r in rows])
    out = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(set(classes.values()))
    whole = {r["doc_id"]: r for r in rows}
    assert all(r == whole[r["doc_id"]] for r in out)


def test_sources_come_near_their_targets(spark, docs):
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sums = Counter()
    for d, n in size.items():
        sums[source[d]] += n
    names = sorted((s for s in sums if s is not None)) + ([None] if None in sums else [])
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(sums.values()) - sum(2.0 * sums[s] for s in full)
        share = rest / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weight[s] * share > 2.0 * sums[s]}
        target = {s: 2.0 * sums[s] if s in full else weight[s] * share for s in names}
        if not more:
            break
        full |= more
    got = q_mixing.op3_source_mixing(spark, SF).collect()
    assert len(got) == len(size)
    taken = Counter()
    for r in got:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sums[source[r["doc_id"]]]) and r["target"] == pytest.approx(target[source[r["doc_id"]]])
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[source[r["doc_id"]]] += r["taken"]
    largest = {s: max(n for d, n in size.items() if source[d] == s) for s in names}  # some ten documents each
    assert all(abs(taken[s] - target[s]) <= max(5.0, largest[s]) for s in names) and abs(sum(taken.values()) - sum(target.values())) < 0.02 * sum(target.values())
    out = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    assert all(out[r["doc_id"]] * r["size"] == r["taken"] for r in got)


def test_packed_pieces_are_those_of_the_tokenizer(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want.update((r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    for got in (q_packing.op7_best_fit_packing(spark, SF).collect(), kept(corpus_pipeline.pack_sequences(spark, docs, SF), "packed").collect()):
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for v in by.values():
            ends = [sum(n for _, n in sorted(v)[:k]) for k in range(len(v) + 1)]
            assert [o for o, _ in sorted(v)] == ends[:-1] and ends[-1] <= 1024
        assert len(by) <= -(-sum(k[3] * n for k, n in want.items()) // 1024) * 1.02 + 1


def test_media_digests_are_of_the_stored_bytes(spark, docs):
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = q_media.op6_media_columns(spark, SF).collect()
    assert len(got) == len(text)
    same = defaultdict(set)
    for r in got:
        raw = text[r["doc_id"]]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > len(payload) and len(r["media_sha256"]) == 64
        same[raw].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v))[0] for v in same.values()}) == len(same)


def test_links_are_counted(spark):
    """Of three texts, the first is linked with both others, which are not linked with each other."""
    words = [f"w{i}" for i in range(204)]
    a = " ".join(words)
    b, c = " ".join([*words[:-18], *(f"x{i}" for i in range(18))]), " ".join([*(f"y{i}" for i in range(18)), *words[18:]])
    d = spark.createDataFrame([(1, a), (2, b), (3, c), (4, a), (5, "other")], "doc_id long, text string")
    from tidebook.llm import dedup

    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in dedup.near_duplicates(d).collect()}
    assert got == {1: (1, 2), 2: (1, 1), 3: (1, 1), 4: (1, 2), 5: (5, 0)}
    assert q_dedup.op8_minhash_near_dedup(spark, SF).columns == ["doc_id", "class_id", "n_links"]
