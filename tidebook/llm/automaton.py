"""Byte-pair encoding by a deterministic automaton over tokens, compiled from the merges."""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append, texts, with_columns
from .tokens import BYTE_LEVEL_PATTERN

#: Words whose ids a worker remembers, and the longest such word in bytes: 50 MB or so.
MEMORY, MEMORABLE = 250_000, 64
#: Rows of a batch that are turned into Python objects at a time.
ROWS = 256


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies, as sign: byte. Bytes that print stand for
    themselves, the others for the code points from 256 on, in order."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass(eq=False)
class Automaton:
    """A deterministic automaton whose arcs bear tokens; its paths from the start are the encodings that merging can give.

    After token t it is in state[t]. An arc with token u leaves state s unless place[u] lies within an odd stretch of
    closed[first[s]:first[s + 1]], a rising list of edges. label[t] is the bytes of t, special the ids of strings that are
    found before all else.
    """

    label: list[bytes]
    place: np.ndarray
    state: np.ndarray
    first: np.ndarray
    closed: np.ndarray
    special: dict[str, int]

    @classmethod
    def compile(cls, label: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]) -> Automaton:
        """From the labels of all tokens, and (left, right, new) of each merge in order.

        It begins as one state with an arc back to itself for each byte. Each merge (u, v) adds a gadget: wherever u and
        then v can be read, an arc with the new token w leads to where v led, and the state after u loses its arc v. All
        arcs of a token lead to one state, so that state, with all that it has lost so far, is what the gadget copies.
        Tokens that begin alike are placed next to each other: u, then what grew from u by later merges, in their order.
        So a state that loses v never gets what grows from v later: one stretch of places.
        """
        grown: list[list[tuple[int, int]]] = [[] for _ in label]  # of u: (merge, w) with u first
        made = set()
        for k, (u, _, w) in enumerate(merges):
            if w not in made:
                grown[u].append((k, w))
                made.add(w)
        place, end = np.full(len(label), -1, np.int32), np.full(len(label), -1, np.int32)
        at, todo = 0, [t for t in range(len(label) - 1, -1, -1) if t not in made]
        while todo:  # places in depth-first order
            t = todo.pop()
            if t < 0:
                end[~t] = at
                continue
            place[t] = at
            at += 1
            todo.append(~t)
            todo += [w for _, w in reversed(grown[t])]
        lost: list[list[tuple[int, int]]] = [[] for _ in label]
        for k, (u, v, w) in enumerate(merges):
            lost[w] = lost[v].copy() if not lost[w] else lost[w]
            later = next((int(place[x]) for m, x in grown[v] if m >= k), int(end[v]))
            lost[u] += [(int(place[v]), int(place[v]) + 1), (later, int(end[v]))]
        number: dict[bytes, int] = {}
        state, edges = np.zeros(len(label), np.int32), []
        for t, stretches in enumerate(lost):
            flat: list[int] = []
            for a, b in sorted(stretches):
                if flat and a <= flat[-1]:
                    flat[-1] = max(flat[-1], b)
                elif a < b:
                    flat += [a, b]
            row = np.array(flat, np.int32)
            key = row.tobytes()
            if key not in number:
                number[key] = len(edges)
                edges.append(row)
            state[t] = number[key]
        first = np.concatenate([[0], np.cumsum([len(e) for e in edges])])
        return cls(label, place, state, first, np.concatenate(edges or [np.zeros(0, np.int32)]), special)

    @classmethod
    def load(cls, path: str) -> Automaton:
        """From a byte-level *.json file of the tokenizers library."""
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocabulary, signs = j["model"]["vocab"], byte_signs()
        special = {a["content"]: a["id"] for a in j["added_tokens"]}
        label = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
        for sign, t in vocabulary.items():
            label[t] = bytes(signs[c] for c in sign)
        for content, t in special.items():
            label[t] = content.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        return cls.compile(label, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], special)

    def walker(self) -> Callable[[bytes], list[int]]:
        """The function that finds the one path whose labels spell a word.

        Each prefix of a word has one path, too. So the longest open arc is followed, and where none leads on, the last one
        is given up for the next shorter; a place that led nowhere is never entered again.
        """
        token = {b: t for t, b in enumerate(self.label) if b and t not in self.special.values()}
        longest = max(map(len, token), default=1)
        place, state = self.place.tolist(), self.state.tolist()
        edges = [array("i", self.closed[a:b].tolist()) for a, b in zip(self.first[:-1], self.first[1:], strict=True)]

        def walk(w: bytes) -> list[int]:
            n = len(w)
            if n <= longest and (t := token.get(w)) is not None:
                return [t]  # a path of one arc
            path: list[int] = []
            starts, dead = [], set()
            i, k, shut = 0, min(n, longest), ()
            while i < n:
                while k > i:
                    t = token.get(w[i:k])
                    if t is not None and k not in dead and not bisect_right(shut, place[t]) & 1:
                        break
                    k -= 1
                if k > i:
                    path.append(t)
                    starts.append(i)
                    i, k, shut = k, min(n, k + longest), edges[state[t]]
                else:
                    dead.add(i)
                    path.pop()
                    i, k = starts.pop(), i - 1
                    shut = edges[state[path[-1]]] if path else ()
            return path

        return walk

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs; bytes that are no UTF-8 become U+FFFD. Ids without a token say nothing."""
        label, n = self.label, len(self.label)
        return b"".join([label[t] for t in ids if t < n]).decode("utf-8", "replace")


class Remembered(dict):
    """Ids of words as little-endian unsigned 32-bit numbers; those of the last MEMORY or so words are kept."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.walk = automaton.walker()

    def __missing__(self, word: str) -> bytes:
        b = word.encode()
        found = np.array(self.walk(b), "<u4").tobytes() if len(b) > MEMORABLE else pack("<%dI" % len(ids := self.walk(b)), *ids)
        if len(b) <= MEMORABLE:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=2)
def encoder(automaton: Automaton) -> Callable[[str], bytes]:
    """The function that turns a text into ids, as little-endian unsigned 32-bit numbers."""
    parts, ids_of = regex.compile(BYTE_LEVEL_PATTERN).findall, Remembered(automaton).__getitem__
    special = {s: pack("<I", t) for s, t in automaton.special.items()}
    cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")").split if special else None

    def encoded(text: str) -> bytes:
        pieces = cut(text) if cut else [text]
        if len(pieces) == 1:
            return b"".join(map(ids_of, parts(text)))
        return b"".join(special[x] if k % 2 else b"".join(map(ids_of, parts(x))) for k, x in enumerate(pieces))

    return encoded


@lru_cache(maxsize=2)
def compiled(path: str) -> Automaton:
    return Automaton.load(path)


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids: what the tokenizers library's encode(text, add_special_tokens=False) gives, as little-endian unsigned
    32-bit numbers (binary).

    path: a byte-level *.json file. The automaton, a few megabytes whatever docs holds, is compiled once and broadcast.
    Null texts count as empty and have no ids; equal texts get equal ids; strings of special tokens in a text get their
    ids. A column ids is replaced; rows stay where they are, repeated ones too. Very long words take time in proportion to
    their length times the longest token's. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compiled(path))
    rest = docs.select(*[c for c in docs.columns if c != "ids"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(shared.value)
        for batch in parts_of(batches):
            yield append(batch, ids=pa.array(list(map(of, texts(batch))), pa.binary()))

    return rest.mapInArrow(encoded, with_columns(rest.schema, [T.StructField("ids", T.BinaryType())]))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded (with ids, as encode() gives them) with decoded: the text of the ids, special ones included.

    Null and empty ids give an empty text, ids that no token has give nothing, bytes that are no UTF-8 U+FFFD. A column
    decoded is replaced; rows stay where they are. An empty table stays empty.
    """
    shared = coded.sparkSession.sparkContext.broadcast(compiled(path))
    rest = coded.select(*[c for c in coded.columns if c != "decoded"])

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in parts_of(batches):
            at = batch.schema.get_field_index("ids")
            found = [automaton.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(at).to_pylist()]
            yield append(batch, decoded=pa.array(found, pa.string()))

    return rest.mapInArrow(emitted, with_columns(rest.schema, [T.StructField("decoded", T.StringType())]))
