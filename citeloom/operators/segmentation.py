"""Dictionary segmentation: the most likely words of a run of characters.

The dictionary is a double-array trie of bounded size, broadcast to the tasks.  A batch
of runs walks it from all its positions at once, which gives the edges of every run's
word graph; one pass over the edges from the right finds the best path.  Weights are
logarithms in fixed point, so a path's weight does not depend on the order of sums.

A character that begins no word is an edge of its own, with the weight of a word seen
once.  Of equally likely paths the one with the longer first word wins, and so on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import CJK_PATTERN, WORD_PATTERN, as_col
from citeloom.operators.joins import row_bound

#: Fixed-point scale of a logarithm.
UNIT = 1_000_000_000
#: Places that are searched at once for a node's children.
WINDOW = 512
#: Words of a dictionary at most; one is a language's, it does not grow with the data.
WORDS = 2_000_000
BYTES = 128 << 20

_NONE = np.iinfo(np.int64).min


def weight(freq: float, total: float) -> int:
    return round((math.log(freq) - math.log(total)) * UNIT)


class Trie:
    """Double-array trie: the child of node v by code c is ``base[v] + c`` if that
    place's ``check`` is v.  ``value`` is the weight of the word that ends there."""

    def __init__(self, words: dict[str, int], single: int):
        self.single = single
        self.alphabet = np.unique(np.array([ord(c) for c in {c for w in words for c in w}], np.uint32))
        code = {chr(c): i + 1 for i, c in enumerate(self.alphabet.tolist())}
        size = 2 * sum(map(len, words)) + 2 * len(code) + 16
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, _NONE, np.int64)
        self.check[0] = 0
        # Nodes breadth first; each is the words below it, and the depth.
        ordered = sorted(words)
        level, free = [(0, 0, len(ordered))], 1
        depth = 0
        while level:
            following = []
            for node, low, high in level:
                children: list[tuple[int, int, int]] = []
                at = low
                if at < high and len(ordered[at]) == depth:
                    self.value[node] = words[ordered[at]]
                    at += 1
                while at < high:
                    c, begin = ordered[at][depth], at
                    while at < high and ordered[at][depth] == c:
                        at += 1
                    children.append((code[c], begin, at))
                if not children:
                    continue
                codes = np.array([c for c, _, _ in children])
                start, free = self._fit(codes, free)
                self.base[node] = start
                self.check[start + codes] = node
                following += [(start + c, a, b) for c, a, b in children]
            level, depth = following, depth + 1
        used = int(np.flatnonzero(self.check >= 0)[-1]) + len(code) + 2
        self._room(used)
        self.base, self.check, self.value = self.base[:used], self.check[:used], self.value[:used]

    def _fit(self, codes: np.ndarray, free: int) -> tuple[int, int]:
        """The first base from ``free`` on whose places for the codes are all free, and
        where the next search begins: behind a window that is nearly full."""
        at = free
        while True:
            self._room(at + WINDOW + int(codes[-1]))
            places = np.flatnonzero(self.check[at : at + WINDOW] < 0) + at
            starts = places - codes[0]
            starts = starts[starts > 0]
            fits = np.flatnonzero((self.check[starts[:, None] + codes] < 0).all(axis=1))
            if len(fits):
                return int(starts[fits[0]]), free
            if at == free and len(places) < WINDOW // 20:
                free += WINDOW
            at += WINDOW

    def _room(self, at: int) -> int:
        if at >= len(self.check):
            more = at + len(self.check) // 2 - len(self.check) + 16
            self.base = np.append(self.base, np.zeros(more, np.int32))
            self.check = np.append(self.check, np.full(more, -1, np.int32))
            self.value = np.append(self.value, np.full(more, _NONE, np.int64))
        return at

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and weight of all words in a row of codes; code 0 is no letter."""
        starts = np.flatnonzero(codes)
        node = np.zeros(len(starts), np.int64)
        found = []
        step = 0
        while len(starts):
            inside = starts + step < len(codes)
            starts, node = starts[inside], node[inside]
            c = codes[starts + step]
            to = self.base[node] + c
            good = (c > 0) & (self.check[np.minimum(to, len(self.check) - 1)] == node)
            starts, node, step = starts[good], to[good], step + 1
            ends = self.value[node] != _NONE
            found.append((starts[ends], starts[ends] + step, self.value[node[ends]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points if len(self.alphabet) else points < 0
        return np.where(known, at + 1, 0)

    def paths(self, runs: list[str]) -> tuple[list[list[int]], list[int], set[tuple[int, int]], np.ndarray]:
        """Ends of the words of each run, its weight, all dictionary edges, and where
        each run begins; places count over the joined runs, one apart."""
        joined = "\0".join(runs) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.codes(points)
        begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in runs])])
        codes[begins[1:] - 1] = 0
        s, e, w = self.edges(codes)
        alone = np.ones(len(points), bool)
        alone[begins[1:] - 1] = False
        alone[s[e == s + 1]] = False
        lone = np.flatnonzero(alone)
        words = set(zip(s.tolist(), e.tolist(), strict=True))
        s, e, w = np.append(s, lone), np.append(e, lone + 1), np.append(w, np.full(len(lone), self.single))
        order = np.lexsort((-e, -s))
        best: list[int | None] = [None] * (len(points) + 1)
        follow = [0] * (len(points) + 1)
        for at in (begins[1:] - 1).tolist():
            best[at] = 0
        for a, b, x in zip(s[order].tolist(), e[order].tolist(), w[order].tolist(), strict=True):
            value = x + best[b]
            if best[a] is None or value > best[a]:
                best[a], follow[a] = value, b
        out, weights = [], []
        for a, b in zip(begins[:-1].tolist(), (begins[1:] - 1).tolist(), strict=True):
            weights.append(best[a])
            ends = []
            while a < b:
                a = follow[a]
                ends.append(a)
            out.append(ends)
        return out, weights, words, begins

    def cut(self, runs: list[str], search: bool = False) -> list[list[str]]:
        """Words of each run; for search, the two- and three-character words inside a
        longer word come before it."""
        paths, _, words, begins = self.paths(runs)
        out = []
        for run, ends, begin in zip(runs, paths, begins[:-1].tolist(), strict=True):
            found, a = [], 0
            for b in (e - begin for e in ends):
                for size in (2, 3) if search else ():
                    if b - a > size:
                        inside = range(a, b - size + 1)
                        found += [run[i : i + size] for i in inside if (begin + i, begin + i + size) in words]
                found.append(run[a:b])
                a = b
            out.append(found)
        return out


def trie(words: DataFrame, added: Iterable[tuple[str, float | None]] = ()) -> Trie:
    """Trie of ``word, freq`` rows and added words.

    An added word without a frequency gets the least that keeps it in one piece.  Blank
    words and those of no positive frequency are left out; of repeated rows the largest
    frequency counts.
    """
    words = words.filter("freq > 0 AND word <> ''").groupBy("word").agg(F.max("freq").alias("freq"))
    if row_bound(words, WORDS, BYTES) is None:
        raise ValueError(f"a dictionary may have {WORDS} words and {BYTES} bytes")
    table = words.toArrow()
    freq = dict(zip(table.column("word").to_pylist(), table.column("freq").to_pylist(), strict=True))
    added = [(w, f) for w, f in added if w]
    wanted = {w: f for w, f in added if f is not None}
    total = float(sum(freq.values()) or 1)
    if any(f is None for _, f in added):
        plain = Trie({w: weight(f, total) for w, f in freq.items()}, weight(1, total))
        for word in (w for w, f in added if f is None):
            whole = math.exp(plain.paths([word])[1][0] / UNIT) * total
            wanted[word] = max(int(whole) + 1, freq.get(word, 0))
    freq.update(wanted)
    total = float(sum(freq.values()) or 1)
    return Trie({w: weight(f, total) for w, f in freq.items()}, weight(1, total))


def broadcast(spark: SparkSession, made: Trie) -> Broadcast:
    return spark.sparkContext.broadcast(made)


def _cutter(held: Broadcast, search: bool) -> Callable[[pa.Array], pa.Array]:
    def run(column: pa.Array) -> pa.Array:
        flat = ["" if r is None else r for r in column.flatten().to_pylist()]
        words = held.value.cut(flat, search) if flat else []
        each = np.cumsum([0, *map(len, words)])
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = each[np.concatenate([[0], np.cumsum(lengths)])]
        values = pa.array([w for ws in words for w in ws], pa.string())
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return run


def segments(runs: Column, held: Broadcast, search: bool = False) -> Column:
    """Words of an array of runs, one after the other; none for a null array."""
    return F.arrow_udf(_cutter(held, search), "array<string>")(runs)


def path_weight(run: Column, held: Broadcast) -> Column:
    """Weight of the best path of a run, in fixed point."""

    def weights(column: pa.Array) -> pa.Array:
        runs = [r or "" for r in column.to_pylist()]
        return pa.array(held.value.paths(runs)[1] if runs else [], pa.int64())

    return F.arrow_udf(weights, "bigint")(run)


def tokenize(value: Column | str, held: Broadcast, pairs: bool = True, pattern: str = CJK_PATTERN) -> Column:
    """Ordered distinct tokens: ASCII words, then the dictionary words of the runs of
    ``pattern``, then the character pairs of ideographic words."""
    lowered = F.lower(F.coalesce(as_col(value), F.lit("")))
    words = F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), F.lit(0))
    cut = segments(F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0)), held, search=True)
    if not pairs:
        return F.array_distinct(F.concat(words, cut))
    ideographs = F.filter(cut, lambda w: w.rlike(CJK_PATTERN) & (F.length(w) >= 2))
    doubles = F.transform(
        ideographs,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2))),
    )
    return F.array_distinct(F.concat(words, cut, F.flatten(doubles)))

