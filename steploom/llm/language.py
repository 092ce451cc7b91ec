"""Language by cross-parsing: the language whose sample text covers a document in the fewest normalised phrases.

For each language a suffix automaton of labelled text is built. A document is read greedily: from each place the
longest string that the automaton knows is one phrase. A phrase costs the logarithm of the sample's length, so the cost
estimates the cross entropy between document and language.

Texts are reduced to letters (lower case) with single gaps between words, and read in blocks, many at a time: all blocks
take one step together, by numpy lookup in the automata's transitions. A block is read as if a phrase began with it; then
those blocks are read again that the one before leaves in the middle of a phrase, until they meet what was read before.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from steploom.llm.shared import written

#: The sample that is fitted on, for each language: so many rows, a stretch of so many characters of each from a hashed
#: place, and so many symbols of these in all, shared evenly by the different stretches.
SAMPLE_ROWS = 150
SAMPLE_CHARS = 2_000
REFERENCE_CHARS = 30_000
SALTS = 32
#: The most frequent symbols have a column each in the table of transitions; those of others are found by bisection.
DENSE = 256
#: Symbols of a block. It bounds steps, not phrases.
BLOCK = 256
#: Symbols that are read together, about.
TOGETHER = 2_000_000

_GAP, _UNSEEN = 0, 1
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")


def _symbols(points: np.ndarray, symbol_of: np.ndarray) -> np.ndarray:
    """Symbols of a text: one gap for each run of other characters, none at the start."""
    out = symbol_of[points]
    gap = out == _GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[:1] = ~gap[:1]
    return out[keep]


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings, by state; 1 is the start, 0 no state."""
    goes: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in symbols.tolist():
        new = len(goes)
        goes.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p and c not in goes[p]:
            goes[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = goes[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(goes)
                goes.append(dict(goes[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and goes[p].get(c) == q:
                    goes[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return goes


class Transitions:
    """The automaton's transitions, and where a phrase ends: no transition leads on, so the symbol begins the next one.

    ``step`` gives the state after a symbol, or its complement (negative) if a phrase began with it; state 0 follows a symbol
    that the sample does not have, and every symbol after it begins a phrase.
    """

    def __init__(self, goes: list[dict[int, int]], n_symbols: int) -> None:
        self.width, self.n_symbols = min(n_symbols, DENSE), n_symbols
        self.start = np.zeros(n_symbols, dtype=np.int64)
        self.start[list(goes[1])] = list(goes[1].values())
        dense = np.zeros((len(goes), self.width), dtype=np.int32)
        rare = []
        for state, row in enumerate(goes):
            for symbol, to in row.items():
                if symbol < self.width:
                    dense[state, symbol] = to
                else:
                    rare.append((state * n_symbols + symbol, to))
        self.dense = np.where(dense > 0, dense, ~self.start[None, : self.width]).astype(np.int32).reshape(-1)
        rare.sort()
        self.keys, self.to = (np.array([r[k] for r in rare] + [-1 if k else 1 << 62], dtype=np.int64) for k in (0, 1))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = self.dense[state * self.width + np.minimum(symbol, self.width - 1)].astype(np.int64)
        beyond = np.flatnonzero(symbol >= self.width)
        if len(beyond):
            key = state[beyond] * self.n_symbols + symbol[beyond]
            at = np.searchsorted(self.keys, key)
            out[beyond] = np.where(self.keys[at] == key, self.to[at], ~self.start[symbol[beyond]])
        return out


def _shared_evenly(parts: list[np.ndarray], total: int) -> list[np.ndarray]:
    """The first symbols of each part, ``total`` together: as many of each, and what short ones leave goes to longer ones."""
    room = {}
    for n, i in enumerate(sorted(range(len(parts)), key=lambda i: len(parts[i]))):
        room[i] = min(len(parts[i]), total // (len(parts) - n))
        total -= room[i]
    return [part[: room[i]] for i, part in enumerate(parts)]


class LanguageReader:
    """Automata of all languages; built in each worker from the samples, which are small."""

    def __init__(self, samples: tuple[tuple[str, tuple[str, ...]], ...]) -> None:
        self.languages = [language for language, _ in samples]
        letters = Counter(c for _, texts in samples for t in texts for c in t.lower() if c.isalpha())
        ranked = sorted(letters, key=lambda c: (-letters[c], c))
        self.symbol_of = np.where(_is_letter(), _UNSEEN, _GAP).astype(np.int32)
        self.symbol_of[[ord(c) for c in ranked]] = np.arange(2, len(ranked) + 2)
        self.tables, self.bits = [], []
        for _, texts in samples:
            parts = [np.append(_symbols(_code_points(t), self.symbol_of), np.int32(_GAP)) for t in dict.fromkeys(texts)]
            reference = np.concatenate([np.zeros(1, np.int32), *_shared_evenly(parts, REFERENCE_CHARS)])
            self.tables.append(Transitions(suffix_automaton(reference), len(ranked) + 2))
            self.bits.append(np.log2(max(len(reference), 2)))

    def costs(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits that each language needs for each text (rows)."""
        out = np.zeros((len(texts), len(self.languages)))
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        if not lengths.sum():
            return out
        flat = np.concatenate(texts).astype(np.int64)
        n_blocks = -(-lengths // BLOCK)
        of = np.repeat(np.arange(len(texts)), n_blocks)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        starts = np.repeat(np.cumsum(lengths) - lengths, n_blocks) + place * BLOCK
        sizes = np.minimum(lengths[of] - place * BLOCK, BLOCK)
        goes_on = np.append(of[1:] == of[:-1], False)  # whether the next block is of the same text
        for k, table in enumerate(self.tables):
            states = np.full(len(flat), -1, dtype=np.int64)  # after each symbol
            begins = np.zeros(len(flat), dtype=bool)  # whether a phrase begins with it
            blocks, state = np.arange(len(of)), np.zeros(len(of), dtype=np.int64)
            while len(blocks):
                longest = np.argsort(-sizes[blocks], kind="stable")
                blocks, state = blocks[longest], state[longest]
                changed = []
                running = np.arange(len(blocks))
                for j in range(BLOCK):
                    running = running[: np.searchsorted(-sizes[blocks[running]], -j, side="left")]
                    if not len(running):
                        break
                    at = starts[blocks[running]] + j
                    to = table.step(state[running], flat[at])
                    begins[at] = to < 0
                    to = np.where(to < 0, ~to, to)
                    differs = states[at] != to
                    states[at] = to
                    state[running] = to
                    # From where a block meets what was read before, all is as it was.
                    running, at = running[differs], at[differs]
                    ends = sizes[blocks[running]] == j + 1
                    changed.append(blocks[running[ends]])
                again = np.concatenate(changed)
                again = again[goes_on[again]]
                blocks, state = again + 1, states[starts[again] + sizes[again] - 1]
            out[:, k] = np.add.reduceat(np.append(begins, False), np.minimum(np.cumsum(lengths) - lengths, len(flat))) * (lengths > 0) * self.bits[k]
        return out

    def read(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        group: list[np.ndarray] = []

        def flush() -> None:
            if not group:
                return
            costs = self.costs(group)
            best = costs.argmin(axis=1)
            odds = np.exp2(-np.minimum(costs - costs.min(axis=1, keepdims=True), 1000))
            for i, b in enumerate(best):
                some = (group[i] != _GAP).any()
                names.append(self.languages[b] if some else UNKNOWN)
                scores.append(odds[i, b] / odds[i].sum() if some else 0.0)
            group.clear()

        held = 0
        for text in texts:
            group.append(_symbols(_code_points(text or ""), self.symbol_of))
            held += len(group[-1])
            if held >= TOGETHER:
                flush()
                held = 0
        flush()
        return names, np.array(scores)


@functools.lru_cache(maxsize=2)
def _reader(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> LanguageReader:
    return LanguageReader(samples)


def learning_rows(doc_id: Column) -> Column:
    """Rows whose language may be learned: four in five, by the checksum of the id's text. Null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple:
    """Samples of each language: at most SAMPLE_ROWS different ids with a letter, chosen by a hash, SAMPLE_CHARS of each.

    Repeated rows count once. An empty table, or one without labels, gives no samples.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = rows.filter(F.col("lang").isNotNull() & learning_rows(F.col("id")) & F.col("text").rlike(r"\p{L}"))
    ids, rank = known.select("id", "lang").distinct(), F.xxhash64("id")
    # The first by hash of each salt, then of all: no task sees more than SALTS times SAMPLE_ROWS rows of the second.
    chosen = ids.withColumn("salt", F.pmod(rank, F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        first = Window.partitionBy(*by).orderBy(rank, "id")
        chosen = chosen.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SAMPLE_ROWS)
    chosen = F.broadcast(written(chosen.select("id", "lang"), "language-sample"))  # SAMPLE_ROWS a language
    # A stretch from a hashed place of the whole text, and one of them for each id however often its row stands there.
    last = F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    stretch = F.substring(F.col("text"), 1 + F.pmod(F.xxhash64("id", "text"), last).cast("int"), F.lit(SAMPLE_CHARS))
    sampled = known.join(chosen, ["id", "lang"]).groupBy("id", "lang").agg(F.min(stretch).alias("text"))
    sample = sampled.select("id", "lang", "text", F.xxhash64("id").alias("h")).toPandas()
    sample = sample.sort_values(["lang", "h", "id", "text"])
    return tuple((str(name), tuple(part["text"])) for name, part in sample.groupby("lang"))


def languages(docs: DataFrame, samples: tuple, text: str = "text") -> DataFrame:
    """Columns ``row`` (all columns of ``docs``), ``lang_pred``, ``score`` (the share of 2^-cost among all languages).

    Whole texts are read. Texts without a letter, null or empty ones, and all texts where nothing was learned, are ``und`` with score 0. Equal
    costs go to the first language by name. Repeated rows give repeated results, an empty table gives none.
    """
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    @F.pandas_udf(kind)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = _reader(samples) if samples else None
        for batch in batches:
            if reader is None:
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(batch), "score": [0.0] * len(batch)})
            else:
                names, scores = reader.read(list(batch))
                yield pd.DataFrame({"lang_pred": names, "score": scores})

    found = docs.select(F.struct("*").alias("row"), read(F.col(text)).alias("found"))
    return found.select("row", "found.lang_pred", "found.score")
