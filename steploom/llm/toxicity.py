"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text, compared window by window.

Windows are single words and pairs of words. For each of the two lengths there is a toxic and an ordinary dictionary. Both begin with
the same ordinary text, so that what is usual costs the same under either; the rest of one is trained on windows of toxic text, that of the
other on as many windows of ordinary text. The compressor's trainer picks what is frequent in its samples, which both kinds of text
share; so the samples of the toxic one are the windows that toxic text has more often than ordinary text, counted by distinct
neighbours, which copies of a text don't raise. Pairs are learned where no word of theirs tells the label alone; their ordinary samples are
pairs of the same words in other company, and only pairs of such words are compared, as no dictionary knows the others.

A window stands in a frame: a mark that all dictionaries end with, so that each pays for its first match alike, and a tail, as
zstandard looks for no match in the last bytes. The bytes that the toxic dictionary saves on a document's windows, and the share of
windows that reach the threshold of their length, are turned into a probability by a logistic function. Thresholds and function are fitted
on labelled rows, each compressed with dictionaries of the other half of the rows.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.llm.shared import Memo, turn_to, written

#: The sample that is fitted on: so many rows of each label at most; of longer texts so many blocks, chosen by hash from all over the text.
SAMPLE_ROWS = 3_000
SAMPLE_BLOCKS = 10
BLOCK_CHARS = 2_000

LEVEL = 12
COMMON_BYTES = 8_000
#: The trained part of a dictionary is twice as long as its different samples, within these bounds.
LEAST_BYTES, SPECIAL_BYTES = 1_000, 4_000
#: The lengths of windows, in words, and the thresholds that are tried for each, in bytes saved.
LENGTHS = (1, 2)
THRESHOLDS = range(1, 13)
#: A word counts as toxic from so many distinct surroundings on.
LEAST_SEEN = 4
#: Windows of each length whose savings a worker remembers: so many of the last ones at least, twice as many at most.
MEMO = 1 << 17
MEMO_CHARS = 63

_MARK = bytes(range(0x80, 0x98))
_TAIL = bytes(range(1, 13))
_WORD = regex.compile(r"\w+|[^\w\s]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _bytes(window: str) -> bytes:
    return f" {window} ".encode("utf-8", "replace")


@dataclass(frozen=True)
class Dictionaries:
    """Of one window length: the toxic and the ordinary dictionary, and the words that windows of several words are made of."""

    toxic: bytes = b""
    ordinary: bytes = b""
    words: frozenset[str] = frozenset()


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries and thresholds by window length, and weights; without both labels to learn from, every score is ``prior``."""

    dictionaries: tuple[Dictionaries, ...] = ()
    thresholds: tuple[int, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.0

    def scorer(self) -> Callable[[str | None], float]:
        turn_to("toxicity")
        savers = [_saver(d.toxic, d.ordinary) for d in self.dictionaries]

        def score(text: str | None) -> float:
            if not self.weights:
                return self.prior
            z = float(np.dot(self.weights, _features(_savings(text, self.dictionaries, savers), self.thresholds)))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=settings)


@functools.lru_cache(maxsize=len(LENGTHS))  # one model's
def _saver(toxic: bytes, ordinary: bytes) -> Callable[[str], int]:
    """The bytes that the toxic dictionary saves on a window, against the ordinary one."""
    by_toxic, by_ordinary = _compressor(toxic).compress, _compressor(ordinary).compress

    def find(window: str) -> int:
        framed = _MARK + _bytes(window) + _TAIL
        return len(by_ordinary(framed)) - len(by_toxic(framed))

    return Memo(find, MEMO, MEMO_CHARS, "toxicity").__getitem__


def _windows(words: list[str], length: int, of: frozenset[str]) -> Counter:
    """The windows of so many words, single ones or all of words in ``of``, each with its number."""
    if length == 1:
        return Counter(words)
    known = [w if w in of else None for w in words]
    return Counter(" ".join(run) for run in zip(*(known[i:] for i in range(length)), strict=False) if None not in run)


def _savings(text: str | None, dictionaries: tuple[Dictionaries, ...], savers: list[Callable[[str], int]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """By window length: the bytes saved on each different window where any are, how often it stands in the text, and the number of words."""
    words = _words(text)
    out = []
    for length, of, saved in zip(LENGTHS, dictionaries, savers, strict=True):
        counts = _windows(words, length, of.words)
        by = np.fromiter((saved(w) for w in counts), dtype=float, count=len(counts))
        n = np.fromiter(counts.values(), dtype=float, count=len(counts))
        out.append((by[by > 0], n[by > 0], len(words)))
    return out


def _share(by: np.ndarray, n: np.ndarray, words: int, threshold: int) -> float:
    return float(np.sqrt(n[by >= threshold].sum() / max(words, 1)))


def _features(savings: list[tuple[np.ndarray, np.ndarray, int]], thresholds: tuple[int, ...]) -> np.ndarray:
    """1; by window length the share at the threshold or over and the mean of squared savings, on a root scale, and the most saved."""
    out = [1.0]
    for (by, n, words), threshold in zip(savings, thresholds, strict=True):
        out += [_share(by, n, words, threshold), np.sqrt((n * by * by).sum() / max(words, 1)), by.max(initial=0) / 8]
    return np.array(out)


def _thresholds(savings: list[list[tuple[np.ndarray, np.ndarray, int]]], y: np.ndarray) -> tuple[int, ...]:
    """By window length, the threshold whose share of windows lies furthest apart in toxic and ordinary rows, in standard errors."""
    best = []
    for at in range(len(LENGTHS)):
        apart = []
        for t in THRESHOLDS:
            share = np.array([_share(*row[at], t) for row in savings])
            error = np.sqrt(share[y > 0].var() / (y > 0).sum() + share[y == 0].var() / (y == 0).sum())
            apart.append((share[y > 0].mean() - share[y == 0].mean()) / (error + 1e-6))
        best.append(THRESHOLDS[int(np.argmax(apart))])
    return tuple(best)


def _coded(texts: list[str], index: dict[str, int]) -> np.ndarray:
    """The words of the texts by their numbers in ``index``, to which new words are added; 0 stands between texts and at both ends."""
    zero = np.zeros(1, dtype=np.int64)
    parts = [zero]
    for text in texts:
        parts += [np.fromiter((index.setdefault(w, len(index)) for w in _words(text)), dtype=np.int64), zero]
    return np.concatenate(parts)


def _codes(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of one or two words in order, each as one number, and the places where they begin."""
    inner = [words[i : len(words) - length + i + 1] for i in range(length)]
    places = np.flatnonzero(np.logical_and.reduce([part > 0 for part in inner]))
    code = inner[0][places]
    for part in inner[1:]:
        code = code << 32 | part[places]
    return code, places


def _surroundings(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The different windows, and how many different pairs of neighbours each has."""
    code, places = _codes(words, length)
    around = words[places - 1] << 32 | words[places + length]
    order = np.lexsort((around, code))
    code, around = code[order], around[order]
    first = np.ones(len(code), dtype=bool)
    first[1:] = (code[1:] != code[:-1]) | (around[1:] != around[:-1])
    return np.unique(code[first], return_counts=True)


def _over(toxic: np.ndarray, ordinary: np.ndarray, length: int) -> np.ndarray:
    """The windows that toxic text has more often, by log-odds less two standard errors."""
    (seen, n), (usual, n_of) = _surroundings(toxic, length), _surroundings(ordinary, length)
    n_seen, n_usual = n.sum(), n_of.sum()
    seen, n = seen[n >= LEAST_SEEN], n[n >= LEAST_SEEN]
    at = np.minimum(np.searchsorted(usual, seen), max(len(usual) - 1, 0))
    m = np.where(usual[at] == seen, n_of[at], 0) if len(usual) else np.zeros(len(seen))
    odds = np.log((n + 0.5) / (n_seen + 1)) - np.log((m + 0.5) / (n_usual + 1))
    return seen[odds - 2 * np.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)) > 0.7]


def _trained(windows: list[str], size: int) -> bytes:
    """``size`` bytes at most of a dictionary trained on the windows, eight to a sample; of too few to train on, the windows themselves.

    The trainer's segments of 32 bytes hold whole windows; half as long ones cut many of them.
    """
    samples = [b"".join(map(_bytes, windows[i : i + 8])) for i in range(0, len(windows), 8)]
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        counts = Counter(windows)
        return b"".join(_bytes(w) for w in sorted(counts, key=lambda w: (counts[w], w)))[-size:]


def _dictionaries(texts: list[str], labels: np.ndarray) -> tuple[Dictionaries, ...]:
    index = {"": 0}
    toxic = _coded([t for t, y in zip(texts, labels, strict=True) if y], index)
    ordinary = _coded([t for t, y in zip(texts, labels, strict=True) if not y], index)
    names = list(index)
    del index
    usual, counts = _surroundings(ordinary, 1)
    out, told = [], np.zeros(0, dtype=np.int64)
    for length in LENGTHS:
        over = _over(toxic, ordinary, length)
        over = over[~np.logical_or.reduce([np.isin(part, told) for part in _parts(over, length)])]
        of = np.unique(np.concatenate(_parts(over, length)))
        told = np.union1d(told, of) if length == 1 else told
        special, _ = _codes(toxic, length)
        special = special[np.isin(special, over)]
        rest, _ = _codes(ordinary, length)
        company = np.logical_and.reduce([np.isin(part, of) for part in _parts(rest, length)]) if length > 1 else True
        rest = rest[~np.isin(rest, over) & company]
        rest = rest[:: max(1, len(rest) // max(len(special), 1))][: len(special)]
        size = min(max(2 * sum(len(_bytes(w)) for w in _named(over, length, names)), LEAST_BYTES), SPECIAL_BYTES)
        trained = _trained(_named(special, length, names), size), _trained(_named(rest, length, names), size)
        shared = ~np.isin(usual, np.union1d(told, of))
        base = _common(usual[shared], counts[shared], names)
        wide = max(map(len, trained))
        toxic_part, ordinary_part = (part.rjust(wide, b" ") for part in trained)
        words = frozenset(names[i] for i in of) if length > 1 else frozenset()
        out.append(Dictionaries(base + toxic_part + _MARK, base + ordinary_part + _MARK, words))
    return tuple(out)


def _parts(codes: np.ndarray, length: int) -> list[np.ndarray]:
    """The numbers of the first, second, ... words of windows."""
    return [codes >> 32 * (length - 1 - i) & 0xFFFFFFFF for i in range(length)]


def _named(codes: np.ndarray, length: int, names: list[str]) -> list[str]:
    return [" ".join(names[i] for i in run) for run in zip(*_parts(codes, length), strict=True)]


def _common(words: np.ndarray, counts: np.ndarray, names: list[str]) -> bytes:
    """The most frequent words, the first at the end, where matches cost least."""
    if len(words) > COMMON_BYTES:  # a word takes a byte at least
        often = counts >= np.partition(counts, -COMMON_BYTES)[-COMMON_BYTES]
        words, counts = words[often], counts[often]
    out, total = [], 0
    for _, word in sorted((-n, names[i]) for i, n in zip(words, counts, strict=True)):
        total += len(word.encode("utf-8", "replace")) + 1
        if total > COMMON_BYTES:
            break
        out.append(word)
    return " ".join(["", *reversed(out)]).encode("utf-8", "replace")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weighted logistic regression by Newton's method, with a small ridge on all but the constant."""
    beta = np.zeros(x.shape[1])
    keep = np.full(len(beta), ridge)
    keep[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - keep * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The logistic fit in which no saving lowers the score: features that would get a negative weight are left out."""
    used = np.ones(x.shape[1], dtype=bool)
    while True:
        beta = _logistic(x * used, y, weight)
        lowers = beta < 0
        lowers[0] = False
        if not lowers.any():
            return beta
        used &= ~lowers


def learning_rows(doc_id: Column) -> Column:
    """Rows whose label may be learned: two in three, by the checksum of the id's text. Null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _blocks(doc_id: Column, text: Column) -> Column:
    """Short texts whole; of longer ones SAMPLE_BLOCKS blocks at most, chosen by hash from the whole text, in its order."""
    n = F.char_length(text)
    blocks = F.ceil(n / BLOCK_CHARS)
    chosen = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_BLOCKS - 1)), lambda k: F.pmod(F.xxhash64(doc_id, k), blocks).cast("int"))
    parts = F.transform(F.array_sort(F.array_distinct(chosen)), lambda k: F.substring(text, k * BLOCK_CHARS + 1, F.lit(BLOCK_CHARS)))
    return F.when(n > SAMPLE_BLOCKS * BLOCK_CHARS, F.concat_ws(" ", parts)).otherwise(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fit on at most SAMPLE_ROWS labelled rows of each kind; of texts longer than SAMPLE_BLOCKS blocks of BLOCK_CHARS, on so many blocks.

    Rows are chosen by a hash of their id, so a sample is spread over all of them and the same every time.
    Null labels are no labels; of several labels of one id the largest counts. Repeated rows of an id are one row, the one of the
    smallest text; an empty table, or one without labels, gives the prior alone.
    """
    ids = docs.select(F.col(doc_id).alias("id")).filter(learning_rows(F.col("id"))).distinct()
    known = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isNotNull())
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .join(ids, "id")
    )
    known = written(known, "labelled")
    share = known.agg(F.avg((F.col("y") > 0).cast("double"))).head()[0]
    by_hash = [F.xxhash64("id"), F.col("id")]
    chosen = known.filter("y > 0").orderBy(*by_hash).limit(SAMPLE_ROWS).unionAll(known.filter("y <= 0").orderBy(*by_hash).limit(SAMPLE_ROWS))
    chosen = F.broadcast(written(chosen, "sample"))  # at most 2 * SAMPLE_ROWS rows
    rows = docs.select(F.col(doc_id).alias("id"), _blocks(F.col(doc_id), F.col(text)).alias("text")).join(chosen, "id")
    # One row for each id before anything is collected, however often it stands there; null is the smallest text.
    text_of = F.min(F.struct("text", "y"))
    rows = rows.groupBy("id").agg(text_of.alias("one")).select("id", "one.text", "one.y").toPandas()
    rows = rows.sort_values("id").reset_index(drop=True)
    y = (rows["y"].to_numpy() > 0).astype(float)
    half = np.array([zlib.crc32(f"half {i}".encode()) % 2 for i in rows["id"]], dtype=bool)
    if min((y[half] > 0).sum(), (y[half] == 0).sum(), (y[~half] > 0).sum(), (y[~half] == 0).sum()) == 0:
        return ToxicityModel(prior=float(share or 0.0))
    texts = list(rows["text"])
    savings: list = [None] * len(rows)
    for learn in (half, ~half):
        fitted = _dictionaries([t for t, h in zip(texts, learn, strict=True) if h], y[learn])
        savers = [_saver(d.toxic, d.ordinary) for d in fitted]
        for i in np.flatnonzero(~learn):
            savings[i] = _savings(texts[i], fitted, savers)
        _saver.cache_clear()  # what these remember is of no further use
    thresholds = _thresholds(savings, y)
    x = np.stack([_features(row, thresholds) for row in savings])
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    weights = tuple(float(b) for b in _rising(x, y, weight))
    return ToxicityModel(_dictionaries(texts, y), thresholds, weights, float(share))


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Columns ``row`` (all columns of ``docs``) and ``score`` (0 to 1; higher: toxic likelier), one row per row of ``docs``.

    Whole texts are scored, by their words and pairs of words alone. Null, empty and blank texts have no window and score as such.
    Repeated rows score alike; an empty table gives no rows.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.scorer()
        for batch in batches:  # one text of it at a time becomes a string of Python
            yield pa.array([of(t.as_py()) for t in batch], pa.float64())

    return docs.select(F.struct("*").alias("row"), score(F.col(text)).alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns."""
    model = fit_toxicity(docs, labels, doc_id, text)
    return toxicity(docs, model, text).filter(F.col("score") < threshold).select("row.*")
