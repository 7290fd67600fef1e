"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import scratch
from .common import append, joined, kept, text_of, texts, with_columns
from .order import filesystem

_WORD = re.compile(r"\w+")
#: Texts whose neighbours are looked up together.
BATCH = 128
#: Words whose terms a worker remembers, 15 MB or so.
REMEMBERED = 100_000


def terms(text: str) -> Counter:
    """How often each term, a lower-cased word, occurs in a text."""
    return Counter(_WORD.findall(text.lower()))


#: Bytes of ASCII: A-Z to a-z, what is no part of a word to a space.
_ASCII = bytes(ord(c.lower()) if _WORD.match(c := chr(i)) else 32 for i in range(128)) + bytes(range(128, 256))


def bag(text: str) -> Counter:
    """terms(text); those of a text of ASCII are bytes."""
    return Counter(text.encode().translate(_ASCII).split()) if text.isascii() else terms(text)


def hashes(words: Collection[str | bytes]) -> np.ndarray:
    """64-bit hashes of words, which stand for them."""
    try:
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    except UnicodeEncodeError:  # lone surrogates
        h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass") if isinstance(w, str) else w) for w in words), np.uint64, len(words))
    return h.view(np.int64)


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(the hash of each term of a text, how often it occurs)."""
    c = bag(text)
    return hashes(c), np.fromiter(c.values(), float, len(c))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] numbers, then those from start[1], and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


@dataclass
class Index:
    """Unit TF-IDF vectors of labelled examples as postings by term.

    A term's vector length is (1 + ln n) * ln((documents + 1) / (documents with it + 1)). vocabulary has the hashes of all
    terms of all examples, rising; a text's other words count in its length only. Examples lie in blocks of one label. The
    postings of term t, places of examples and weights, begin at term_at[t]. Long lists, of terms in a share of long_share
    of the examples or more, are in full[row[t]] instead, a weight for each place, with the largest weight of each block
    in top; so they take at most 1 / long_share times the mean number of an example's terms rows.
    """

    vocabulary: np.ndarray
    idf: np.ndarray
    telling: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    block: int
    term_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    full: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 1), np.float32))
    top: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    telling_norm: np.ndarray = field(default_factory=lambda: np.zeros(0))
    block_label: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    prior: float = 0.5
    documents: float = 0.0
    known: dict[str | bytes, int] = field(default_factory=dict)

    @classmethod
    def build(cls, vocabulary: np.ndarray, idf: np.ndarray, telling: np.ndarray, labels: np.ndarray, ids: np.ndarray, example: np.ndarray, term: np.ndarray, n: np.ndarray, block: int = 64, long_share: float = 0.1) -> Index:
        """From the examples' labels and ids, and how often (n) each term occurs in each example: rows sorted by example."""
        size = len(labels)
        x = (1.0 + np.log(n)) * idf[term]
        norm = np.sqrt(np.bincount(example, x * x, size))
        x /= np.maximum(norm, 1e-300)[example]
        n_terms, commonest = np.bincount(example, minlength=size), np.full(size, -1)
        by_n = np.lexsort((term, n))  # the commonest term tells languages apart
        commonest[example[by_n]] = term[by_n]
        order = np.lexsort((np.arange(size), n_terms, commonest, labels))  # like examples share a block
        gap = np.where(labels[order] == 1, -int((labels == 0).sum()) % block, 0)  # a block has one label
        at = np.empty(size, np.int64)
        at[order] = np.arange(size) + gap
        total = -(-(int(at.max()) + 1) // block) * block if size else 0
        self = cls(vocabulary, idf, telling, np.zeros(total, np.int64), np.full(total, -1, np.int64), block)
        self.labels[at], self.ids[at] = labels, ids
        self.block_label = self.labels[::block]
        p = at[example]
        self.telling_norm = np.sqrt(np.bincount(p, telling[term] * x**2, total))
        o = np.lexsort((p, term)).astype(np.int32)
        term, p, x = term[o], p[o].astype(np.int32), x[o].astype(np.float32)
        del o
        lists = np.bincount(term, minlength=len(vocabulary))
        long = np.flatnonzero(lists >= max(1.0, long_share * size))
        self.row = np.full(len(vocabulary), -1, np.int32)
        self.row[long] = np.arange(len(long))
        self.full = np.zeros((len(long), total // block, block), np.float32)
        in_full = self.row[term] >= 0
        self.full.reshape(len(long), total)[self.row[term[in_full]], p[in_full]] = x[in_full]
        self.top = self.full.max(axis=2, initial=0.0)
        self.place, self.weight = p[~in_full].astype(np.int32), x[~in_full]
        self.term_at = np.searchsorted(term[~in_full], np.arange(len(vocabulary) + 1))
        return self

    def places(self, words: np.ndarray) -> np.ndarray:
        """The term of each hash of a word, -1 for a word of no example."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        order, at = np.argsort(words), np.empty(len(words), np.int64)
        at[order] = np.searchsorted(self.vocabulary, words[order])  # rising ones are found several times as fast
        at = np.minimum(at, len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def vector(self, words: np.ndarray, n: np.ndarray, rest: float | None = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of a text's unit vector, from hashes of its words and how often they occur.

        rest: the squared length of the part that lies outside the examples' terms; None: those words occur in no document.
        A term that all documents have weighs nothing.
        """
        t = self.places(words)
        return self.unit(t[t >= 0], n[t >= 0], n[t < 0], rest)

    def unit(self, t: np.ndarray, n: np.ndarray, others: np.ndarray, rest: float | None) -> tuple[np.ndarray, np.ndarray]:
        """vector() from the terms that examples have, and how often they and the other words occur."""
        x = (1.0 + np.log(n)) * self.idf[t]
        if rest is None:
            rest = float((((1.0 + np.log(others)) * math.log(1.0 + self.documents)) ** 2).sum())
        norm = math.sqrt(float(x @ x) + rest)
        return (t, x / norm) if norm else (t[:0], x[:0])

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the terms of a text that examples have, how often they occur, the hashes of its other words, how often those do)."""
        c = bag(text)
        n = np.fromiter(c.values(), float, len(c))
        t = np.fromiter(map(self.known.get, c, repeat(-1)), np.int64, len(c))
        new = np.flatnonzero(t < 0)
        words = list(c)
        words = [words[i] for i in new.tolist()]
        h = hashes(words)
        t[new] = at = self.places(h)
        if len(self.known) < REMEMBERED:
            self.known.update((words[i], int(at[i])) for i in np.flatnonzero(at >= 0).tolist())
        return t[t >= 0], n[t >= 0], h[at < 0], n[new[at < 0]]

    def short_part(self, vectors: list[tuple[np.ndarray, np.ndarray]], near: list[np.ndarray] | None = None) -> np.ndarray:
        """For each vector and place the sum of products over the terms with short lists; with near only for each vector's
        places there, one vector's after another's.
        """
        out = np.zeros((len(vectors), len(self.labels)), np.float32) if near is None else []
        for i, (t, q) in enumerate(vectors):
            start = self.term_at[t]
            size = self.term_at[t + 1] - start
            at = _ranges(start, size)
            total = np.bincount(self.place[at], np.repeat(q, size) * self.weight[at], len(self.labels))
            if near is None:
                out[i] = total
            else:
                out.append(total[near[i]].astype(np.float32))
        return out if near is None else np.concatenate(out)

    def long_part(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each vector its weights of the terms with long lists."""
        out = np.zeros((len(vectors), len(self.full)), np.float32)
        for i, (t, q) in enumerate(vectors):
            long = self.row[t] >= 0
            out[i, self.row[t[long]]] = q[long]
        return out

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None, first: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector (places, cosines) of the k examples of each label of largest cosine above 0, ties by place;
        but: for each vector the id of an example to leave out.

        Short lists are added up whole. The largest sum of a block, and for each long list the vector's weight times the
        block's largest, bound what the block holds. For each label the blocks of largest bounds are completed, then those
        whose bound is not below the k-th cosine found; the others can't have a nearer example, so it is exact.
        """
        n, n_blocks, size = len(vectors), len(self.block_label), self.block
        if not n_blocks:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        q = self.long_part(vectors)
        score = self.short_part(vectors).reshape(n, n_blocks, size)
        bound = score.max(axis=2) + q @ self.top
        hidden = None
        if but is not None:
            hidden = (self.ids == np.array(but)[:, None]).reshape(n, n_blocks, size) & (self.ids >= 0).reshape(n_blocks, size)
        done = np.zeros((n, n_blocks), bool)

        def complete(todo: np.ndarray) -> None:
            for b in np.flatnonzero(todo.any(axis=0)):
                rows = np.flatnonzero(todo[:, b])
                score[rows, b] += q[rows] @ self.full[:, b]
            done.__ior__(todo)

        todo, first_of = np.zeros((n, n_blocks), bool), []
        for y in (0, 1):
            of = np.flatnonzero(self.block_label == y)
            first_of.append(of[np.argsort(-bound[:, of], axis=1, kind="stable")[:, :first]])
            np.put_along_axis(todo, first_of[y], True, axis=1)
        complete(todo & (bound > 0))
        todo, least = (bound > 0) & ~done, np.zeros((2, n), np.float32)
        for y in (0, 1):  # the k-th cosine found so far
            of, rows = np.flatnonzero(self.block_label == y), np.arange(n)[:, None]
            s = np.where(done[rows, first_of[y]][:, :, None], score[rows, first_of[y]], 0.0)
            if hidden is not None:
                s[hidden[rows, first_of[y]]] = 0.0
            s = s.reshape(n, -1)
            if s.shape[1] > k:
                least[y] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            todo[:, of] &= bound[:, of] >= least[y][:, None] - 1e-5
        complete(todo)
        good = (score >= least[self.block_label].T[:, :, None]) & (score > 0) & done[:, :, None]
        if hidden is not None:
            good &= ~hidden
        own, at = np.nonzero(good.reshape(n, -1))  # all of the k nearest, and some others
        s, label = score.reshape(n, -1)[own, at], self.labels[at]
        order = np.lexsort((at, -s, label, own))
        own, at, s, label = own[order], at[order], s[order], label[order]
        group = own * 2 + label
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        own, at, s = own[rank < k], at[rank < k], s[rank < k]
        cuts = np.searchsorted(own, np.arange(1, n))
        return list(zip(np.split(at, cuts), np.split(s.astype(float), cuts), strict=True))

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None, mass: float = 1.0) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each vector (share of label 1 among the neighbours, their places, their cosines).

        A neighbour's vote weighs as much as its cosine over the telling part of both vectors times how far the words
        that they share tell, or the fourth power of its whole cosine, if that is more. The share is drawn to the prior
        by a mass that stands for no evidence.
        """
        if not vectors:
            return []
        some = [(t[self.telling[t] > 0], q[self.telling[t] > 0]) for t, q in vectors]
        tell = [(t, self.telling[t] ** 2 * q) for t, q in some]
        found, long, flat, out = self.nearest(vectors, k, but), self.long_part(tell), self.full.reshape(len(self.full), len(self.labels)), []
        short = np.split(self.short_part(tell, [near for near, _ in found]), np.cumsum([len(near) for near, _ in found])[:-1])
        for i, (near, cosine) in enumerate(found):
            told = short[i] + (long[i, used] @ flat[used[:, None], near] if len(used := np.flatnonzero(long[i])) else 0.0)
            t, q = some[i]
            norm = self.telling_norm[near] * math.sqrt(float(self.telling[t] @ (q * q)))
            w = np.maximum(np.where(norm > 0, told / np.where(norm > 0, norm, 1.0), 0.0), cosine**4)
            out.append((float((w @ self.labels[near] + mass * self.prior) / (w.sum() + mass)), near, cosine))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best rising fit of y on x (pool adjacent violators), between which one interpolates."""
    order = np.argsort(x, kind="stable")
    held: list[list[float]] = []  # mean, weight, weighted x
    for i in order:
        held.append([y[i], w[i], x[i] * w[i]])
        while len(held) > 1 and held[-2][0] >= held[-1][0]:
            b, a = held.pop(), held[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[2] += b[2]
    return np.array([h[2] / h[1] for h in held]), np.clip([h[0] for h in held], 0.0, 1.0)


def telling_part(with_1: np.ndarray, with_0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How far each term tells label 1, 0 to 1, from numbers of examples with it.

    The square of certainty times contrast: the squared standard errors by which its share is larger among label 1, over
    that of the largest of as many terms without meaning, 1 at most; and the difference of both shares over their sum.
    Under 0.01 it is none.
    """
    a, b = with_1 / max(1, n1), with_0 / max(1, n0)
    share = (with_1 + with_0) / max(1, n0 + n1)
    z = np.maximum(a - b, 0.0) / np.sqrt(share * (1.0 - share) * (1.0 / max(1, n1) + 1.0 / max(1, n0)) + 1e-12)
    certain = np.minimum(z * z / max(1.0, 2.0 * math.log(max(2, len(z)))), 1.0)
    part = (certain * np.maximum(a - b, 0.0) / np.maximum(a + b, 1e-300)) ** 2
    return np.where(part >= 0.01, part, 0.0)


@lru_cache(maxsize=1)
def _loaded(file: str) -> Index:
    """The index that a task wrote; a worker process reads it once."""
    files, path = filesystem(file)
    with files.open_input_stream(path) as f:
        return pickle.loads(f.read())


@dataclass
class Model:
    """The file of the index of examples, in the shared folder (None: there is no toxic example), and empty, an index without
    any; steps, points between which votes become chances; and rest, for the hash (key) of every text of the documents the
    squared length of what its words that no example has add to its vector. So the driver holds no example."""

    file: str | None
    empty: Index
    steps: tuple[np.ndarray, np.ndarray]
    rest: DataFrame

    @property
    def index(self) -> Index:
        return _loaded(self.file) if self.file else self.empty


def _lengths(docs: DataFrame, vocabulary: np.ndarray) -> tuple[DataFrame, np.ndarray, int]:
    """(key and rest of every distinct text, the number of documents with each term of vocabulary, and of all documents).

    One pass over the words: a task sums up what it has of the vocabulary, and gives the other words of each text, whose
    document frequencies are counted by hash, joined back and summed up by text. Copies of a text count as documents, but
    are one text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index.build(vocabulary, np.zeros(len(vocabulary)), np.zeros(len(vocabulary)), *[np.zeros(0, np.int64)] * 4, np.zeros(0)))
    names = ["key", "word", "n"]

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, df, rows = shared.value, np.zeros(len(shared.value.vocabulary), np.int64), 0
        for batch in batches:
            keys, held = batch.column(0).to_numpy(), []
            for text in texts(batch):
                t, _, words, n = index.read(text)
                df[t] += 1
                held.append((words, n))
            rows += len(held)
            sizes = [len(w) for w, _ in held]
            columns = [np.repeat(keys, sizes), np.concatenate([w for w, _ in held]), np.concatenate([n for _, n in held])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=names)
            plain = keys[np.array(sizes) == 0]  # texts without such words
            yield pa.RecordBatch.from_arrays([pa.array(plain), pa.nulls(len(plain), pa.int64()), pa.array(np.zeros(len(plain)))], names=names)
        seen = np.flatnonzero(df)
        words = pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(index.vocabulary[seen])])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), words, pa.array(np.concatenate([[rows], df[seen]]).astype(float))], names=names)

    found = kept(docs.select(F.xxhash64(text_of()).alias("key"), "text").mapInArrow(parted, "key long, word long, n double"), "words")
    shared.unpersist()
    total = found.filter("key is null").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # a row a term, and that of all documents
    none = total["word"].is_null()
    documents, terms_of, df = int(pc.sum(total.filter(none)["n"]).as_py() or 0), total.filter(pc.invert(none)), np.zeros(len(vocabulary))
    df[np.searchsorted(vocabulary, terms_of["word"].to_numpy())] = terms_of["n"].to_numpy()
    pairs = found.filter("key is not null").groupBy("key", "word").agg(F.any_value("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    pairs = kept(pairs, "word-pairs")
    counts = pairs.filter("word is not null").groupBy("word").agg(F.sum("copies").alias("df"))
    long = joined(pairs, counts, "word", "key", limit=1 << 20)  # pairs are narrow: a shuffle of them costs less than a broadcast
    size = F.pow((1 + F.log("n")) * F.log((F.lit(documents) + 1) / (F.col("df") + 1)), F.lit(2))
    parts = long.select("key", size.alias("size")).unionByName(pairs.filter("word is null").select("key", F.lit(0.0).alias("size")))
    return kept(parts.groupBy("key").agg(F.sum("size").alias("rest")), "text-lengths"), df, documents


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: tuple[int, int] = (4_000, 2_000), k: int = 16) -> Model:
    """The model of a bounded sample of labelled rows, with frequencies of all words over all documents.

    labels: doc_id and toxic (0 or 1; of several rows for a document the largest counts). train: on the columns of
    labels, which of them may be used. Sample: of each label the first rows in the order of a hash, per_class of label
    0 and 1; every word of their whole texts is a term, so the sample bounds the index. Words are told apart by 64-bit
    hashes. Document frequencies cover all of docs. Votes are calibrated on the examples themselves, each without itself,
    weighted to the labels' own proportions. Of several rows of docs with a labelled doc_id one is taken, by its text's hash.
    """
    spark = docs.sparkSession
    rows = kept(labels.filter(train).groupBy("doc_id").agg(F.max("toxic").alias("label")).filter("doc_id is not null and label in (0, 1)"), "labels-used")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    picked = [rows.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in enumerate(per_class)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most sum(per_class) rows

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed(x) for x in texts(batch)]
            order = [np.argsort(w) for w, _ in found]
            of = [pa.array([w[o] for (w, _), o in zip(found, order, strict=True)], pa.list_(pa.int64())), pa.array([n[o].astype(np.int32) for (_, n), o in zip(found, order, strict=True)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *of], names=["doc_id", "label", "hash", "words", "counts"])

    own = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "label", F.xxhash64("text").alias("hash"), "text").mapInArrow(bags, "doc_id long, label int, hash long, words array<long>, counts array<int>")
    held = kept(own.groupBy("doc_id").agg(F.min_by(F.struct("label", "words", "counts"), F.struct("hash", "words")).alias("x")).select("doc_id", "x.*"), "examples")
    vocabulary = np.sort(held.select(F.explode("words").alias("word")).distinct().toArrow()["word"].to_numpy())
    rest, df, documents = _lengths(docs, vocabulary)
    known, folder = spark.sparkContext.broadcast((vocabulary, df, documents, prior)), scratch(spark, "index")

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The examples, at most sum(per_class) rows, meet in one task, which writes the index and gives its sizes and file. A
        task that runs again writes a file of its own."""
        parts = [b.select(["doc_id", "label", "words", "counts"]) for b in batches]
        vocabulary, df, documents, prior = known.value
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        label, ids = t["label"].to_numpy().astype(np.int64), t["doc_id"].to_numpy().copy()
        term = np.searchsorted(vocabulary, pc.list_flatten(t["words"]).to_numpy()).astype(np.int32)
        example = np.repeat(np.arange(len(label), dtype=np.int32), pc.list_value_length(t["counts"]).to_numpy())
        n = pc.list_flatten(t["counts"]).to_numpy().astype(np.float32)
        n1 = int(label.sum())
        with_1, with_0 = (np.bincount(term[label[example] == y], minlength=len(vocabulary)) for y in (1, 0))
        index = Index.build(vocabulary, np.log((1.0 + documents) / (1.0 + df)), telling_part(with_1, with_0, n1, len(label) - n1), label, ids, example, term, n)
        index.prior, index.documents = prior, documents
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.index"
        with files.open_output_stream(f"{path}/{name}") as f:
            pickle.dump(index, f, 5)
        yield pa.RecordBatch.from_arrays([pa.array([len(label)]), pa.array([n1]), pa.array([f"{folder}/{name}"])], names=["n", "n1", "file"])

    made = held.coalesce(1).sortWithinPartitions("doc_id").mapInArrow(built, "n long, n1 long, file string").collect()  # a row at most
    known.unpersist()
    size, n1, file = made[0] if made else (0, 0, None)
    empty = Index.build(vocabulary[:0], np.zeros(0), np.zeros(0), *[np.zeros(0, np.int64)] * 4, np.zeros(0))
    empty.prior, empty.documents = prior, documents
    del vocabulary, df
    pa.default_memory_pool().release_unused()
    if not n1:
        return Model(None, empty, (np.array([0.0, 1.0]), np.array([prior, prior])), rest)

    def without_itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _loaded(file)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                ids, words, counts = (part.column(i).to_pylist() for i in (0, 2, 3))
                vectors = [x.vector(np.array(w, np.int64), np.array(c, float)) for w, c in zip(words, counts, strict=True)]
                votes = [v for v, _, _ in x.votes(vectors, k, but=ids)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(votes, pa.float64())], names=["doc_id", "label", "vote"])

    parts = held.repartition(max(1, min(64, size // 64)), "doc_id")
    votes = parts.mapInArrow(without_itself, "doc_id long, label int, vote double").orderBy("doc_id").toArrow()
    y = votes["label"].to_numpy()
    steps = isotonic(votes["vote"].to_numpy(), y.astype(float), np.where(y == 1, prior / n1, (1 - prior) / max(1, size - n1)))
    return Model(file, empty, steps, rest)


def score(docs: DataFrame, model: Model, k: int = 16, evidence: int = 3) -> DataFrame:
    """docs with score (calibrated chance of label 1) and evidence (the nearest examples: doc_id, similarity, label).

    Similarities are of whole texts: words that no example has make a text longer. docs are rows of those that the model was
    fitted to; in another text such words count as seen in no document. Empty and null texts, and those without a word
    of the examples, have no neighbour and get the calibrated prior. Equal texts get equal scores, repeated rows too; a
    very long text takes time in proportion to its distinct words. Columns of these names are replaced. The lengths of
    texts, 16 bytes each, are broadcast if they are small, else rows meet them by their text's hash.
    """
    file, empty, steps = model.file, model.empty, model.steps
    near_type = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    added = [T.StructField("score", T.DoubleType()), T.StructField("evidence", near_type)]
    rest = docs.select(*[c for c in docs.columns if c not in ("score", "evidence", "_key", "_rest")])
    known = model.rest.select(F.col("key").alias("_key"), F.col("rest").alias("_rest"))
    marked = joined(rest.withColumn("_key", F.xxhash64(text_of())), known, "_key", *rest.columns, how="left").select(*rest.columns, "_rest")
    arrow = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _loaded(file) if file else empty
        for batch in batches:
            found, why = [], []
            held = list(zip(texts(batch), batch.column(batch.num_columns - 1).to_pylist(), strict=True))
            for start in range(0, len(held), BATCH):
                for vote, near, cosine in x.votes([x.unit(t, n, others, r) for (t, n, _, others), r in ((x.read(text), r) for text, r in held[start : start + BATCH])], k):
                    found.append(float(np.interp(vote, *steps)))
                    top = np.lexsort((near, -cosine))[:evidence]
                    why.append([{"doc_id": int(x.ids[near[i]]), "similarity": float(cosine[i]), "label": int(x.labels[near[i]])} for i in top])
            bare = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            yield append(bare, score=pa.array(found, pa.float64()), evidence=pa.array(why, arrow))

    return marked.mapInArrow(scored, with_columns(rest.schema, added))
