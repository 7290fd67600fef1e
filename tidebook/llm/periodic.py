"""Runs of repeated words, found by a suffix automaton whose link tree is recoloured by accesses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append, texts, with_columns


def suffix_links(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link of each state, its longest length, the state of each prefix) of the suffix automaton of ids; state 0
    is the empty string's."""
    step: list[dict[int, int]] = [{}]
    link, length, ends, last = [-1], [0], [], 0
    for c in ids:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] != length[p] + 1:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
        ends.append(new)
    return link, length, ends


def last_meetings(link: list[int], length: list[int], ends: list[int]) -> Iterator[tuple[int, int, int]]:
    """For each place i and each j < i that is the last earlier end of some suffix of what ends at i: (i, j, the length of the
    longest such suffix).

    The tree of suffix links is held as a link-cut tree: paths of one colour, the last place at which their strings ended,
    are splay trees by depth. To access the state of prefix i walks from its node to the root, a path of one colour at a
    time, and joins what it passed to a path of colour i. A colour is kept at the root of its splay tree. A walk passes
    O(log n) colours, amortised.
    """
    up = [max(0, x) for x in link]
    above, below, colour = [0] * len(link), [0] * len(link), [-1] * len(link)
    for i, x in enumerate(ends):
        joined = 0
        while x:
            while True:  # x becomes the root of its splay tree
                p = up[x]
                if not p or (above[p] != x and below[p] != x):
                    break
                g = up[p]
                inner = g and (above[g] == p or below[g] == p)
                for y in ((p, x) if (above[p] == x) == (above[g] == p) else (x, x)) if inner else (x,):
                    q = up[y]
                    r = up[q]
                    if above[q] == y:
                        z = above[q] = below[y]
                        below[y] = q
                    else:
                        z = below[q] = above[y]
                        above[y] = q
                    if z:
                        up[z] = q
                    up[q], up[y] = y, r
                    if above[r] == q and r:
                        above[r] = y
                    elif below[r] == q and r:
                        below[r] = y
                    else:
                        colour[y] = colour[q]
            j = colour[x]
            if j >= 0:
                yield i, j, length[x]
                if below[x]:
                    colour[below[x]] = j
            below[x] = joined
            joined, x = x, up[x]
        colour[joined] = i


def stretches(ids: np.ndarray, least_count: int, least_length: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of at least least_length numbers, each of which occurs least_count times in its stretch:
    no run of that exponent and length reaches beyond one."""
    where, of, m = np.arange(len(ids)), np.zeros(len(ids), np.int64), int(ids.max(initial=0)) + 1
    while len(where):
        _, back, n = np.unique(of * m + ids[where], return_inverse=True, return_counts=True)
        good = n[back] >= least_count
        new = where[good]
        cut = np.ones(len(new), bool)
        cut[1:] = (np.diff(new) > 1) | (np.diff(of[good]) > 0)
        of_new = np.cumsum(cut) - 1
        long = np.bincount(of_new, minlength=1)[of_new] >= least_length if len(new) else cut
        if good.all() and long.all():
            starts = np.flatnonzero(cut)
            return list(zip(new[starts].tolist(), (new[np.append(starts[1:], len(new)) - 1] + 1).tolist(), strict=True))
        where, of = new[long], of_new[long]
    return []


def runs(words: list, least_length: int = 6, least_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of words, by start, then period.

    Let two prefixes' longest common suffix have length s, and end d words apart: its words and the d before them have
    period d. If s >= 2 d, a last occurrence is nearest at the smallest period, and the suffix can't be extended to the
    left; so a run of exponent 3 or more is met at its last word, once, with d its period and s + d its length.
    """
    if least_exponent < 3:
        raise ValueError("runs of an exponent under 3 may hide behind others")
    if len(words) < least_length:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    found = []
    for a, b in stretches(ids, least_exponent, least_length):
        own = ids[a:b].tolist()
        for i, j, s in last_meetings(*suffix_links(own)):
            d = i - j
            if s >= (least_exponent - 1) * d and s + d >= least_length and (i + 1 == len(own) or own[i + 1] != own[i + 1 - d]):
                found.append((a + i + 1 - s - d, s + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def find_runs(docs: DataFrame, least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """docs with runs (array of start, length and period in words, by start, then period) and collapsed (the words that no
    run contains after its first period, joined by one space).

    Words are runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return, told apart
    by every byte. A run has a smallest period, spans least_exponent periods and least_length words at least, and can't be
    extended. Null, empty and wordless texts have no run and an empty collapsed text; equal texts get equal values. Columns
    of these names are replaced; rows stay where they are, repeated ones too. A text is one row in one task: about 300
    bytes a word of stretches whose words all repeat, else about 100. An empty table stays empty.
    """
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    added = [T.StructField("runs", T.ArrayType(kind)), T.StructField("collapsed", T.StringType())]
    rest = docs.select(*[c for c in docs.columns if c not in ("runs", "collapsed")])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, short = [], []
            for text in texts(batch):
                words = text.encode().split()
                found = runs(words, least_length, least_exponent)
                lists.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                short.append(b" ".join(collapsed(words, found)).decode())
            of = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
            yield append(batch, runs=pa.array(lists, of), collapsed=pa.array(short, pa.string()))

    return rest.mapInArrow(searched, with_columns(rest.schema, added))
