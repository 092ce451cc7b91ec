"""SimHash fingerprints, near duplicates by covering hashing, and one document of each group.

Covering hashing: give each of the 64 bit places a code of r + 1 bits, for radius r. For each of the 2^(r+1) - 1 codes v
other than 0, keep the places whose code has an odd number of bits in common with v. At most r places that differ
have at most r codes, so some v is orthogonal to them all and its mask keeps none of them: every pair within the radius
is equal under some mask. With r = 3 there are 15 masks of 32 to 36 bits.

A bucket (mask, bits under it) of many fingerprints is not compared pair by pair: its members differ in the bits that the
mask leaves out, and those are covered by masks again, and once more, after which at most 2^9 fingerprints can differ.
So no bucket is capped, no pair within the radius is missed, and no task holds more than one such small bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from steploom.llm.components import components
from steploom.llm.shared import ascii_lower, small, written

BITS = 64
RADIUS = 3
SHINGLE = 3
#: Buckets of more fingerprints are covered again.
DENSE = 128
#: Buckets whose members can differ in at most so many places are small by arithmetic.
LAST = 9


def masks(free: list[int], radius: int) -> list[list[int]]:
    """For each mask, the places of ``free`` that it keeps; codes go round the places, so masks are alike in size."""
    codes = [1 + i % ((1 << (radius + 1)) - 1) for i in range(len(free))]
    return [[p for p, c in zip(free, codes, strict=True) if (c & v).bit_count() % 2] for v in range(1, 1 << (radius + 1))]


def _signed(places: list[int]) -> int:
    value = sum(1 << p for p in places)
    return value - (1 << 64) if value >> 63 else value


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


@F.pandas_udf(LongType())
def _majority(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The bits that are set in over half of each row's hashes; 0 for none."""
    for batch in hashes:
        out = np.zeros(len(batch), dtype=np.int64)
        for i, values in enumerate(batch):
            if values is not None and len(values):
                count = np.zeros(BITS, dtype=np.int64)
                for at in range(0, len(values), 1 << 16):
                    part = np.ascontiguousarray(values[at : at + (1 << 16)], dtype="<i8")
                    bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    count += bits.sum(axis=0, dtype=np.int64)
                out[i] = np.packbits(2 * count > len(values), bitorder="little").view("<i8")[0]
        yield pd.Series(out)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``text_hash``, ``fingerprint`` (long) per row. Null, empty and blank texts have fingerprint 0."""
    rows = docs.select(
        F.col(doc_id).alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
        F.explode(F.array(_words(F.col(text)))).alias("w"),
    )
    count = F.size("w")
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(count - (shingle - 1), F.lit(1))),
        lambda at: F.xxhash64(F.array_join(F.slice("w", at, shingle), " ")),
    )
    hashes = F.when(count > 0, each).otherwise(F.array().cast("array<long>"))
    return rows.select("id", "text_hash", _majority(hashes).alias("fingerprint"))


def _linked_in(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of one small bucket that a link joins to others, each with the smallest member it is joined to."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    root = np.arange(len(values))
    while True:
        least = np.where(near, root[None, :], len(values)).min(axis=1)
        least = least[least]
        if (least == root).all():
            break
        root = least
    moved = root != np.arange(len(values))
    return values[moved], values[root[moved]]


def _bucket_links(radius: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [], []
            for members in batch["members"]:
                x, y = _linked_in(np.asarray(members, dtype=np.int64).view(np.uint64), radius)
                a.append(x)
                b.append(y)
            none = np.zeros(0, dtype=np.uint64)
            yield pd.DataFrame({"a": np.concatenate([none, *a]).view(np.int64), "b": np.concatenate([none, *b]).view(np.int64)})

    return links


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fingerprint``) that join all pairs within the radius.

    Each bucket gives a spanning set of its links, at most one per member, not all of its pairs.
    """
    # Level 0 has one group, all fingerprints, and all places are free.
    groups = {"": list(range(BITS))}
    rows = distinct.select("fingerprint")
    out = None
    while True:
        finer: dict[str, list[int]] = {}
        keys = []
        for path, free in groups.items():
            for v, keep in enumerate(masks(free, radius), 1):
                name = f"{path}{v:x}"
                finer[name] = [p for p in free if p not in set(keep)]
                keys.append((path, name, _signed([p for p in range(BITS) if p not in set(finer[name])])))
        if len(groups) == 1:
            choices = F.array(*[F.struct(F.lit(mask).alias("mask"), F.lit(bits).alias("bits")) for _, mask, bits in keys])
            masked = rows.select("fingerprint", F.inline(choices))
        else:
            table = distinct.sparkSession.createDataFrame(keys, "path string, mask string, bits long")
            masked = rows.join(F.broadcast(table), "path")
        cut = masked.select(
            "fingerprint", F.col("mask").alias("path"), F.col("fingerprint").bitwiseAND(F.col("bits")).alias("kept")
        )
        sparse, dense = cut, None
        if max(len(free) for free in finer.values()) > LAST:
            dense = written(
                cut.groupBy("path", "kept").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > DENSE), "dense-buckets"
            ).select("path", "kept")
            n_dense = dense.count()
            sparse = cut.join(small(dense, n_dense), ["path", "kept"], "left_anti") if n_dense else cut
        members = sparse.groupBy("path", "kept").agg(F.collect_list("fingerprint").alias("members"))
        links = members.filter(F.size("members") > 1).select("members").mapInPandas(_bucket_links(radius), "a long, b long")
        out = links if out is None else out.unionAll(links)
        if dense is None or not n_dense:
            return out
        rows = cut.join(small(dense, n_dense), ["path", "kept"])
        groups = finer


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """Per row of ``docs``: ``id``, ``text_hash``, ``fingerprint`` (long), ``root`` (a fingerprint of its component) and
    ``component``, the smallest id reachable.

    Fingerprints link at ``radius`` or fewer differing bits; equal ones always. Texts without words share fingerprint 0 and
    link like any other. Null ids are never the smallest; a component of null ids alone is null. Repeated rows get equal
    rows. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = written(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(distinct, radius))
    rooted = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component")), "components")
    of = written(rooted.join(least, "root").select("fingerprint", "root", "component"), "members")
    return rows.join(of, "fingerprint").select("id", "text_hash", "fingerprint", "root", "component")


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest id.

    Of rows that share this id, the text of the smallest hash stays, once. Of null ids alone, one row stays.
    """
    found = written(near_duplicates(docs.select(doc_id, text), doc_id, text, **options), "near-duplicates")
    keep = (
        found.groupBy("root")
        .agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "text_hash")).alias("first"))
        .select(F.col("first.id").alias("_keep_id"), F.col("first.text_hash").alias("_keep_hash"))
    )
    keep = written(keep, "kept")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(doc_id).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
    )
    same = F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_hash") == F.col("_keep_hash"))
    out = rows.join(keep, same)
    if not found.groupBy("id", "text_hash").count().filter(F.col("count") > 1).isEmpty():  # rows that stand there twice
        out = out.dropDuplicates(["_id", "_hash"])
    return out.select("row.*")
