"""Alignment of two tokenizers on the same bytes, by divide and conquer at shared cuts.

A text's tokens of both tokenizers cover the same bytes. Both tokenizers end a token at the end of the text; this is the
first shared cut. An interval between shared cuts is divided at a shared end near its middle: the ends of A are tried from
the middle outwards, each looked up among the ends of B by bisection, and both parts are divided in the same way. An
interval without another shared end is a leaf, one group of tokens. All intervals of many texts are divided side by side, one
depth after the other, by numpy.

Tokens whose bytes overlap are linked. How many links of the whole corpus hold each pair of ids is summed in Spark.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from steploom.llm.shared import small, written
from steploom.llm.tokens import PIECES, byte_letters, plain_encoder

#: Stretches of text that a worker remembers; the memo is emptied when it is full. Longer ones are not remembered.
MEMO = 700_000
MEMO_CHARS = 60
#: Characters of text that are read and aligned together, about.
TOGETHER = 1 << 18

#: Fixed: how the piece tokenizer writes a space, and a byte without a piece of its own.
SPACE = "▁"
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")

#: A stretch is a word with the space before it: blank, tab, line feed. Other white space and the space letter itself
#: send the whole text to the libraries.
STRETCH = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
UNUSUAL = re.compile(r"[^\S \n\t]|[\x1c-\x1f▁]")


#: Ids of A and of B as little-endian 32-bit numbers, and whether the tokens of both are exactly the text's bytes.
Tokens = tuple[bytes, bytes, bool]
NO_TOKENS: Tokens = (b"", b"", False)


def ordinary_encoder(path: str, byte_of: dict[str, int]) -> Callable[[str], list[int]]:
    """Ids of ordinary text by a byte-level BPE file.

    A vocabulary whose merges make its ids in ascending order is the same as ranks of byte strings, which the tiktoken library
    reads several times as fast.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made) or not all(c in byte_of for token in model["vocab"] for c in token):
        encode = plain_encoder(path)
        return lambda text: np.frombuffer(encode(text), "<u4").tolist()
    import tiktoken

    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Pair:
    """A byte-level BPE file (A) and a piece model (B) that read the same text, A with a space before it."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        self.encode_a = ordinary_encoder(path_a, byte_of)
        vocabulary = Tokenizer.from_file(path_a).get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            # An added token is no sequence of byte letters, and no ordinary text is encoded as one.
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.model = SentencePieceProcessor(model_file=path_b)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_b = []
        for i, piece in enumerate(pieces):
            byte = BYTE_PIECE.fullmatch(piece) if self.model.is_byte(i) else None
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode())
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.length_a, self.length_b = (np.array(list(map(len, x)), dtype=np.int32) for x in (self.bytes_a, self.bytes_b))
        self.space = self.model.piece_to_id(SPACE)
        # Stretches can be read apart only if no piece holds the end of one and the start of the next.
        self.apart = not any(re.search(f"[^ \n\t{SPACE}][ \n\t{SPACE}]|{SPACE}[\n\t]", piece) for piece in pieces)
        self.memo: dict[str, Tokens] = {}

    def _checked(self, spaced: str, b: list[int]) -> Tokens:
        a, data = self.encode_a(spaced), spaced.encode("utf-8", "replace")
        same = b"".join(map(self.bytes_a.__getitem__, a)) == data == b"".join(map(self.bytes_b.__getitem__, b))
        return array("I", a).tobytes(), array("I", b).tobytes(), same

    def _stretches(self, new: list[str]) -> dict[str, Tokens]:
        """Tokens of stretches, those of B read by the library in one call."""
        # The library puts a space before what it reads: before a stretch that has none it goes again.
        ids = self.model.encode([s[1:] if s[0] == " " else s for s in new])
        found = {}
        for s, b in zip(new, ids, strict=True):
            if s[0] != " ":
                found[s] = self._checked(s, b[1:]) if b[:1] == [self.space] else NO_TOKENS
            else:
                found[s] = self._checked(s, b or [self.space])
        return found

    def tokens(self, texts: list[str | None]) -> list[Tokens]:
        """Tokens of whole texts; none if a text is null or empty, or if the tokens of A or B are not its bytes."""
        out, memo = [], self.memo
        cut = [STRETCH.findall(" " + t) if t and self.apart and not UNUSUAL.search(t) else [] for t in texts]
        if len(memo) >= MEMO:
            memo.clear()
        new = list(set(chain.from_iterable(cut)).difference(memo))
        known = self._stretches(new) if new else {}
        memo.update((s, t) for s, t in known.items() if len(s) <= MEMO_CHARS)
        long = {s: t for s, t in known.items() if len(s) > MEMO_CHARS}
        for text, stretches in zip(texts, cut, strict=True):
            found = None
            if stretches:
                a, b, same = zip(*[memo.get(s) or long[s] for s in stretches], strict=True)
                if all(same):
                    found = b"".join(a), b"".join(b), True
            if found is None and text:
                found = self._checked(" " + text, self.model.encode(text))
            out.append(found if found and found[2] else NO_TOKENS)
        return out


@functools.lru_cache(maxsize=1)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shared cuts, as how many tokens of A and of B end there or before, found from those that are known.

    ``ends_a`` and ``ends_b`` ascend. ``cuts_a`` and ``cuts_b`` are the known shared cuts, the first (0, 0) and the last the end
    of both; each interval between two of them is divided.
    """
    low_a, high_a, low_b, high_b = cuts_a[:-1], cuts_a[1:], cuts_b[:-1], cuts_b[1:]
    tried = np.zeros(len(low_a), dtype=np.int32)
    found_a, found_b = [cuts_a], [cuts_b]
    while True:
        inner = high_a - low_a - 1  # ends of A inside
        open_ = (tried < inner) & (high_b - low_b > 1)
        low_a, high_a, low_b, high_b, tried, inner = (x[open_] for x in (low_a, high_a, low_b, high_b, tried, inner))
        if not len(low_a):
            break
        # The middle, then by turns one more to the left and to the right of it.
        at = low_a + inner // 2 + np.where(tried % 2 == 1, -((tried + 1) // 2), tried // 2)
        place = np.searchsorted(ends_b, ends_a[at]).astype(np.int32)
        hit = ends_b[place] == ends_a[at]
        cut_a, cut_b = at[hit] + 1, place[hit] + 1
        found_a.append(cut_a)
        found_b.append(cut_b)
        miss = ~hit
        low_a, high_a = np.concatenate([low_a[hit], cut_a, low_a[miss]]), np.concatenate([cut_a, high_a[hit], high_a[miss]])
        low_b, high_b = np.concatenate([low_b[hit], cut_b, low_b[miss]]), np.concatenate([cut_b, high_b[hit], high_b[miss]])
        tried = np.concatenate([np.zeros(2 * len(cut_a), dtype=np.int32), tried[miss] + 1])
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


@functools.lru_cache(maxsize=2)
def _digits(size: int) -> np.ndarray:
    """Decimal digits of the numbers below ``size``, right-aligned, 0 where there is none."""
    powers = 10 ** np.arange(len(str(size - 1)) - 1, -1, -1)
    numbers = np.arange(size)[:, None]
    return np.where((numbers >= powers) | (powers == 1), numbers // powers % 10 + ord("0"), 0).astype(np.uint8)


def group_texts(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, groups: np.ndarray) -> list[bytes]:
    """For each document, of so many ``groups``, its groups as ``a1,a2|b1;a3|b2,b3``."""
    size_a, size_b = np.diff(cuts_a), np.diff(cuts_b)
    group_a, group_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
    at_a = np.arange(len(a)) + cuts_b[group_a]
    at_b = np.arange(len(b)) + cuts_a[group_b + 1]
    ids = np.empty(len(a) + len(b), dtype=np.int32)
    ids[at_a], ids[at_b] = a, b
    mark = np.full(len(ids), ord(","), dtype=np.uint8)
    mark[at_a[cuts_a[1:] - 1]], mark[at_b[cuts_b[1:] - 1]] = ord("|"), ord(";")
    table = _digits(max(int(ids.max(initial=0)) + 1, 1 << 16))
    letters = np.concatenate([table[ids], mark[:, None]], axis=1)
    used = letters != 0
    ends = np.cumsum(used.sum(axis=1))
    data = letters[used].tobytes()
    tokens = np.concatenate([[0], (cuts_a + cuts_b)[np.cumsum(groups)]])
    bounds = np.concatenate([[0], ends])[tokens].tolist()
    return [data[s : max(e - 1, s)] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


class Aligned(NamedTuple):
    """Of each document: numbers of tokens, groups and links, the groups' text, and its different linked pairs, coded as
    id of B times the size of A's vocabulary plus id of A, with how often each is linked (``ends``: where its pairs end)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    pairs: np.ndarray
    times: np.ndarray
    ends: np.ndarray


def align(found: list[Tokens], pair: Pair) -> Aligned:
    a, b = (np.frombuffer(b"".join(part), "<u4").astype(np.int32) for part in ([t[0] for t in found], [t[1] for t in found]))
    n_a, n_b = (np.array([len(x) // 4 for x in part], dtype=np.int64) for part in ([t[0] for t in found], [t[1] for t in found]))
    # Of some texts together, whose bytes and tokens are below 2^31.
    ends_a, ends_b = (np.cumsum(x, dtype=np.int32) for x in (pair.length_a[a], pair.length_b[b]))
    some = n_a > 0
    known = [np.insert(np.cumsum(n[some], dtype=np.int32), 0, 0) for n in (n_a, n_b)]
    cuts_a, cuts_b = shared_cuts(ends_a, ends_b, *known)
    until = np.searchsorted(cuts_a, np.insert(np.cumsum(n_a), 0, 0))
    n_groups = np.diff(until)
    # Each stretch between two ends, of whichever tokenizer, is the overlap of one token of A and one of B.
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")
    ends = ends[np.diff(ends, prepend=-1) > 0]
    link_a, link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    n_links = n_a + n_b - n_groups
    codes = pair.size_a * pair.size_b
    of = np.repeat(np.arange(len(found)), n_links)
    keys, times = np.unique(of * codes + b[link_b].astype(np.int64) * pair.size_a + a[link_a], return_counts=True)
    per = np.searchsorted(keys, np.arange(1, len(found) + 1) * codes)
    return Aligned(n_a, n_b, n_groups, n_links, group_texts(a, b, cuts_a, cuts_b, n_groups), keys % codes, times, per)


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (``a1,a2|b1;a3|b2,b3``, ids in order; null without
    tokens), ``pairs`` (different linked pairs, coded as id of B times the size of A's vocabulary plus id of A) and ``times`` (how often).

    Null and empty texts, and texts whose tokens of A or B are not exactly the bytes of a space and the text, have no tokens:
    zeros and empty lists. Special tokens' strings are plain text. Ids may be null, of any type, repeated; other columns are not
    read; an empty table gives no rows.
    """
    fields = [StructField("id", docs.schema[doc_id].dataType), *[StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]]
    fields += [StructField("groups", StringType()), StructField("pairs", ArrayType(LongType())), StructField("times", ArrayType(LongType()))]
    names = [f.name for f in fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for batch in batches:
            texts, held, first = [], 0, 0
            for row, value in enumerate(batch.column("text")):
                texts.append(value.as_py())
                held += len(texts[-1] or "")
                if held >= TOGETHER or row + 1 == batch.num_rows:
                    done = align(pair.tokens(texts), pair)
                    offsets = pa.array(np.concatenate([[0], done.ends]), pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (done.pairs, done.times)]
                    groups = pa.array([g or None for g in done.groups], pa.string())
                    counts = [pa.array(x, pa.int64()) for x in (done.n_a, done.n_b, done.n_groups, done.n_links)]
                    ids = batch.column("id").slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays([ids, *counts, groups, *lists], names)
                    texts, held, first = [], 0, row + 1

    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(read, StructType(fields))


def with_link_counts(aligned: DataFrame, size_a: int) -> DataFrame:
    """``aligned`` without ``pairs`` and ``times``, with ``n_best`` (links of a pair that is linked as often in the corpus as any pair of
    its B id, ties included) and ``count_sum`` (the corpus counts of its pairs, over all links).

    ``aligned`` is written once. Counts are summed before the shuffle, so a pair that all documents hold moves as one row per
    task. They are broadcast if they are few (counted), else joined by shuffle, where Spark splits frequent pairs.
    """
    rows = written(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    held = rows.select("row", F.inline(F.arrays_zip("pairs", "times")))
    counts = written(held.groupBy("pairs").agg(F.sum("times").alias("n")), "pair-counts")
    of_b = F.call_function("div", F.col("pairs"), F.lit(size_a).cast("long"))
    highest = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("highest"))
    ranked = counts.join(highest, of_b == F.col("b")).select("pairs", "n", (F.col("n") == F.col("highest")).alias("best"))
    ranked = written(ranked, "ranked-pairs")
    sums = held.join(small(ranked), "pairs").groupBy(F.col("row").alias("of")).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    joined = rows.select(*kept, "row").join(sums, F.col("row") == F.col("of"), "left")
    return joined.select(*kept, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))
