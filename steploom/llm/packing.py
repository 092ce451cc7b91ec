"""Pack tokenised documents into sequences: vector best fit under token, document and attention capacities.

Pieces are dealt to groups of some 2^23 tokens by a hash of their row's place in a written table, so copies of one row are dealt
like others; each group is packed by one task, and no group depends on the size of the input. A group leaves a few sequences unfilled, out of some 4,000.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from steploom.llm.shared import written
from steploom.llm.tokens import batch_encoder

#: Tokens and pieces that one task packs, about, whichever it reaches first.
GROUP_TOKENS = 1 << 23
GROUP_PIECES = 200_000
#: Pieces that a task gathers before it hands them to Spark.
BATCH_PIECES = 2_000


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    max_tokens: int = 2048,
    end_id: int = 0,
    keep_ids: bool = False,
) -> DataFrame:
    """Per piece: ``id``, ``piece`` (from 0), ``start``, ``length``, ``ids_crc32`` and, if wanted, ``ids``.

    A document is the ids of its whole text and ``end_id``; null text is empty. Only documents of more than
    ``max_tokens`` are cut; their first piece is the shorter one, so that all others fill a sequence.
    """
    fields = [StructField("id", docs.schema[doc_id].dataType), StructField("piece", IntegerType())]
    fields += [StructField(c, LongType()) for c in ("start", "length", "ids_crc32")]
    fields += [StructField("ids", ArrayType(IntegerType()))] if keep_ids else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = batch_encoder(tokenizer), np.uint32(end_id).tobytes()
        for batch in batches:
            of, out = [], []
            for row, found in enumerate(itertools.chain.from_iterable(encode(batch.column("text")))):
                ids = np.frombuffer(found + end, dtype="<u4")
                first = len(ids) % max_tokens or max_tokens
                bounds = [0, *range(first, len(ids) + 1, max_tokens)]
                for k, (a, b) in enumerate(itertools.pairwise(bounds)):
                    of.append(row)
                    out.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype("<i4")))
                if len(out) >= BATCH_PIECES or row == batch.num_rows - 1:
                    piece, start, length, crc, part = zip(*out, strict=True)
                    columns = [batch.column("id").take(pa.array(of)), pa.array(piece, pa.int32()), *map(pa.array, (start, length, crc))]
                    columns += [pa.array(part, pa.list_(pa.int32()))] if keep_ids else []
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
                    of, out = [], []

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(cut, StructType(fields))


def best_fit(
    demands: np.ndarray, capacities: np.ndarray, weights: np.ndarray, measure: str = "norm"
) -> tuple[np.ndarray, int]:
    """The bin of each item (rows of ``demands``), and the number of bins. Items come in the order they are given.

    Of the open bins with room in every dimension the item takes, by weighted capacities as shares of the whole:
    ``norm``: that with the smallest residual left; ``dot``: that whose residual points most in the item's direction,
    of equals the one with the smallest residual. It opens a new bin only if none has room.
    """
    share = demands / capacities
    room = np.ones((len(demands), demands.shape[1]))
    bins = np.full(len(demands), -1)
    open_bins = np.zeros(len(demands), dtype=np.int64)
    n_open = n_bins = 0
    least = share.min(axis=0)
    for i, need in enumerate(share):
        at = open_bins[:n_open]
        left = room[at] - need
        fits = (left >= -1e-12).all(axis=1)
        if fits.any():
            left = left[fits]
            size = (weights * left * left).sum(axis=1)
            if measure == "dot":
                had = left + need
                score = (weights * had * need).sum(axis=1) / np.sqrt((weights * had * had).sum(axis=1))
                size = size - np.round(score, 9) * 1e6
            place = np.flatnonzero(fits)[int(size.argmin())]
            b = at[place]
        else:
            b, place = n_bins, n_open
            open_bins[n_open] = b
            n_bins, n_open = n_bins + 1, n_open + 1
        bins[i] = b
        room[b] -= need
        if (room[b] < least - 1e-12).any():  # no item fits any more
            n_open -= 1
            open_bins[place] = open_bins[n_open]
    return bins, n_bins


def pack(
    pieces: DataFrame,
    max_tokens: int = 2048,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    measure: str = "norm",
    group_tokens: int = GROUP_TOKENS,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (place in the sequence, gapless from 0).

    A sequence holds at most ``max_tokens`` tokens, ``max_docs`` pieces and ``max_attention`` as sum of squared lengths
    (defaults: as many as tokens allow). Bins are chosen by all three, whether a limit was given or not. Every piece is placed
    whole, repeated rows too; no pieces give no rows.
    Raises ValueError for limits that a piece of ``max_tokens`` can't meet.
    """
    attention = max_tokens * max_tokens if max_attention is None else max_attention
    capacities = np.array([max_tokens, max_docs or max_tokens, attention], dtype=float)
    if capacities.min() < 1 or attention < max_tokens * max_tokens and pieces.filter(F.col("length") * F.col("length") > attention).head(1):
        raise ValueError("a piece is beyond the limits of a sequence")
    held = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    total, count = held.agg(F.sum("length"), F.count(F.lit(1))).head()
    n_groups = max(1, round((total or 0) / group_tokens), -(-count // group_pieces))
    # Token ids stay out of the groups: they are joined to the places afterwards, so a task holds lengths and not texts.
    slim = ["piece", "length", "ids_crc32", "_row"] if "ids" in pieces.columns else held.columns
    dealt = held.select(*slim, F.pmod(F.xxhash64("_row"), F.lit(n_groups)).alias("group"))
    fields = [held.schema[c] for c in slim]
    schema = StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def fill(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "piece", "_row"], ascending=[False, True, True, True]).drop(columns="group")
        length = rows["length"].to_numpy(dtype=float)
        full = length >= max_tokens
        demands = np.stack([length, np.ones(len(length)), length * length], axis=1)
        bins = np.arange(len(rows))
        packed, _ = best_fit(demands[~full], capacities, np.array(weights), measure)
        bins[~full] = full.sum() + packed
        rows["sequence_id"] = (int(key[0]) << 32) + bins
        rows["offset"] = rows.groupby("sequence_id", sort=False)["length"].cumsum() - rows["length"]
        return rows

    places = dealt.groupBy("group").applyInPandas(fill, schema)
    if "ids" in pieces.columns:
        places = held.join(places.select("_row", "sequence_id", "offset"), "_row")
    return places.select(*pieces.columns, "sequence_id", "offset")
