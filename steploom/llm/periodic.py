"""Periodic runs of words: stretches that repeat one period, found among the suffixes of a text.

Suffixes that share a prefix form classes. Pairs of neighbours in suffix order are taken by descending length of their
common prefix (LCP), as Kruskal's algorithm takes edges; each unites two classes, which are ordered sets of positions. Two
positions that become neighbours in the united set, at a distance within the LCP, seed a run: the distance is its smallest
period, as any smaller one would have put a position between them before, and the run is LCP plus period long. It
starts where the word before the first position differs from the one before the second.

Each document is read alone, in one task, in memory proportional to it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Positions of one block of an ordered set; a block of twice as many is split.
BLOCK = 512
#: Documents that are handed over together.
TOGETHER = 500

Run = tuple[int, int, int]


def shortest_prefix(power: int, least: int) -> int:
    """The least LCP of two positions that start a wanted run, over all periods."""
    return min(max((power - 1) * q, least - q) for q in range(1, max(least, 1) + 1))


def _gram_ranks(words: np.ndarray, size: int) -> np.ndarray:
    """For each place the rank of its next ``size`` words (0 beyond the end) among all places, equal for equal words.

    A rank is the number of smaller ones, as the refinement of classes needs it.
    """
    n = len(words)
    padded = np.concatenate([words, np.zeros(size, dtype=np.int64)])
    key, top = padded[:n].copy(), int(words.max()) + 1
    reach = top
    for k in range(1, size):
        if reach * top >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            reach = n
        key = key * top + padded[k : k + n]
        reach *= top
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - counts)[inverse].astype(np.int32)


def _may_hold_runs(words: np.ndarray, size: int, power: int) -> bool:
    """False only if no run of the wanted power is there: it needs a stretch of places whose next ``size`` words come again
    within a distance that fits into the stretch."""
    n = len(words) - size + 1
    if n < 2:
        return False
    key = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n].astype(np.uint64) + np.uint64(1)
    key ^= key >> np.uint64(29)  # equal words have equal keys; a pair of others that has them too only costs time
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return False
    order = np.argsort(key, kind="stable")
    again = key[order[1:]] == key[order[:-1]]
    distance = np.zeros(n, dtype=np.int64)
    distance[order[:-1][again]] = (order[1:] - order[:-1])[again]
    places = np.flatnonzero(distance)
    first = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    length = np.diff(first, append=len(places))
    nearest = np.minimum.reduceat(distance[places], first)
    return bool((nearest * (power - 1) <= length + size - 1).any())


def _suffixes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that share ``size`` words or more with another, in suffix order, and the LCP of each with the one after it,
    or less than ``size`` where these are of different classes."""
    n = len(words)
    rank = np.append(_gram_ranks(words, size), np.int32(-1))
    active = np.argsort(rank[:n], kind="stable")
    same = np.diff(rank[active]) == 0
    active = active[np.append(same, False) | np.insert(same, 0, False)]
    shared, levels, width = active, [(size, rank.copy())], size
    while len(active):
        old = rank[active].astype(np.int64)
        key = old * (n + 2) + rank[active + width] + 1
        order = np.argsort(key, kind="stable")
        active, key, old = active[order], key[order], old[order]
        at = np.arange(len(active))
        starts = np.insert(np.diff(key) != 0, 0, True)
        classes = np.insert(np.diff(old) != 0, 0, True)
        rank[active] = old + np.maximum.accumulate(np.where(starts, at, 0)) - np.maximum.accumulate(np.where(classes, at, 0))
        active = active[~(starts & np.append(starts[1:], True))]
        width *= 2
        levels.append((width, rank.copy()))
    shared = shared[np.argsort(rank[shared], kind="stable")]
    a, b = shared[:-1].copy(), shared[1:].copy()
    first, padded = a.copy(), np.append(words, 0)
    for width, ranks in reversed(levels):
        same = ranks[a] == ranks[b]
        a += np.where(same, width, 0)
        b += np.where(same, width, 0)
    for _ in range(size - 1):
        same = padded[a] == padded[b]
        a += same
        b += same
    return shared, a - first


def _beside(blocks: list[list[int]], x: int) -> tuple[int, int, int, int]:
    """Where ``x`` belongs in an ordered set, as block and place, and its neighbours there (-1: none)."""
    k = max(bisect_left(blocks, [x]) - 1, 0)
    block = blocks[k]
    at = bisect_left(block, x)
    before = block[at - 1] if at else -1
    after = block[at] if at < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else -1
    return k, at, before, after


def _insert(blocks: list[list[int]], k: int, at: int, x: int) -> None:
    block = blocks[k]
    block.insert(at, x)
    if len(block) > 2 * BLOCK:
        blocks.insert(k + 1, block[BLOCK:])
        del block[BLOCK:]


def periodic_runs(words: np.ndarray, power: int = 4, least: int = 6) -> list[Run]:
    """Start, length and smallest period of every run of at least ``power`` periods (two or more) and ``least`` words.

    ``words`` are numbers from 1. Runs are sorted by start, then period.
    """
    if power < 2:
        raise ValueError("a run has at least two periods")
    size = shortest_prefix(power, least)
    if not _may_hold_runs(words, size, power):
        return []
    suffixes, lcp = _suffixes(words, size)
    positions, text = suffixes.tolist(), words.tolist()
    parent = list(range(len(positions)))
    sets: dict[int, list[list[int]]] = {}
    sizes: dict[int, int] = {}
    runs = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_length = np.argsort(-lcp, kind="stable")
    for edge, length in zip(by_length.tolist(), lcp[by_length].tolist(), strict=True):
        if length < size:
            break
        large, little = root(edge), root(edge + 1)
        if sizes.get(large, 1) < sizes.get(little, 1):
            large, little = little, large
        parent[little] = large
        blocks = sets.pop(large, None) or [[positions[large]]]
        joining = list(chain.from_iterable(sets.pop(little, None) or [[positions[little]]]))
        sizes[large] = sizes.get(large, 1) + len(joining)
        reach = length // (power - 1)
        last = -1
        for i, x in enumerate(joining):
            k, at, before, after = _beside(blocks, x)
            # Neighbours only if both are of different sets: not those that have just joined, nor across the next that will.
            pairs = []
            if before > last:
                pairs.append((before, x))
            if after >= 0 and (i + 1 == len(joining) or joining[i + 1] > after):
                pairs.append((x, after))
            for s, t in pairs:
                period = t - s
                if period <= reach and length + period >= least and (s == 0 or text[s - 1] != text[t - 1]):
                    runs.append((s, length + period, period))
            _insert(blocks, k, at, x)
            last = x
        sets[large] = blocks
    return sorted(runs, key=lambda run: (run[0], run[2]))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers, from 1, for equal words."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, count(1)), dtype=np.int64, count=len(words))


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", power: int = 4, least: int = 6) -> DataFrame:
    """Per row of ``docs``: ``id``, ``n_words``, ``runs`` (``start``, ``length``, ``period``, by start, then period) and
    ``collapsed``, the words of the text, joined by one space, without those that a run holds after its first period.

    Words are what stands between ASCII white space. Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``. Repeated rows give repeated results, ids may be of any type or null, other columns are not read, an
    empty table gives no rows.
    """
    run = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    fields = [StructField("id", docs.schema[doc_id].dataType), StructField("n_words", LongType()), StructField("runs", ArrayType(run))]
    schema = StructType([*fields, StructField("collapsed", StringType())])
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                sizes, found, collapsed = [], [], []
                for value in part.column("text"):
                    words = (value.as_py() or b"").split()
                    runs = periodic_runs(word_numbers(words), power, least)
                    sizes.append(len(words))
                    found.append(runs)
                    collapsed.append(b" ".join(without_repeats(words, runs) if runs else words))
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                flat = np.array(list(chain.from_iterable(found)), dtype=np.int64).reshape(-1, 3)
                items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run_type))
                columns = [part.column("id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, items), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(read, schema)
