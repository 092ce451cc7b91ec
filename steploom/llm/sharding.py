"""Shards by a Feistel permutation with cycle walking over global row numbers.

Rows get their place in one order of the whole table (id, then text, then the other columns), so the numbering depends on
the rows alone, not on files, partitions or the run. The permutation turns a row number into a place p of the shuffled
table; p modulo the shards is the shard and p divided by them the slot. Nothing else is stored: shard and slot of any row
number, and the row number of any shard and slot, follow from the seed and the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from steploom.llm.shared import small, written

#: Rounds of the permutation; an even number, so that both halves are mixed equally often.
ROUNDS = 6
#: Rows of one range partition, about.
RANGE_ROWS = 1_000_000
#: Steps that every row outside the table may walk; any that are left then walk as far as the domain allows.
WALK = 8

#: Fixed: two primes below 2^31, and a multiplier below them, of the round function.
PRIME, PRIME_2 = 2_147_483_647, 2_147_483_629
FACTOR = 1_588_635_695


def sides(n_rows: int) -> tuple[int, int]:
    """The domain of the permutation: a times b places, at least ``n_rows`` and fewer than ``n_rows + a``."""
    a = max(1, math.isqrt(max(n_rows - 1, 0)) + 1)
    return a, max(1, -(-n_rows // a))


def round_keys(seed: int) -> list[int]:
    return [(seed * 40_503 + i * 1_103_515_245 + 12_345) % PRIME for i in range(ROUNDS)]


def _mixed(half, key):
    """The round function, for columns and for whole numbers: a square, as a shift alone would leave rows in step; no product
    reaches 2^62."""
    moved = (half + key) % PRIME
    return moved * moved % PRIME * FACTOR % PRIME_2


def _div(x, by: int):
    return F.call_function("div", x, F.lit(by).cast("long")) if isinstance(x, Column) else x // by


def _step(x: int, n_rows: int, seed: int) -> int:
    a, b = sides(n_rows)
    left, right = divmod(x, b)
    for i, key in enumerate(round_keys(seed)):
        if i % 2:
            right = (right + _mixed(left, key)) % b
        else:
            left = (left + _mixed(right, key)) % a
    return left * b + right


def _step_column(x: Column, n_rows: int, seed: int) -> Column:
    """The same for a column: in each round the halves, and their sides, change places."""
    a, b = sides(n_rows)
    halves = lambda *values: F.struct(*[v.alias(name) for v, name in zip(values, ("left", "right", "side", "other"), strict=True)])
    start = halves(_div(x, b), x % b, F.lit(a).cast("long"), F.lit(b).cast("long"))
    keys = F.array(*[F.lit(key).cast("long") for key in round_keys(seed)])
    turn = lambda at, key: halves(at["right"], (at["left"] + _mixed(at["right"], key)) % at["side"], at["other"], at["side"])
    return F.aggregate(keys, start, turn, lambda at: at["left"] * b + at["right"])


def _step_back(x: int, n_rows: int, seed: int) -> int:
    a, b = sides(n_rows)
    left, right = divmod(x, b)
    for i, key in reversed(list(enumerate(round_keys(seed)))):
        if i % 2:
            right = (right - _mixed(left, key)) % b
        else:
            left = (left - _mixed(right, key)) % a
    return left * b + right


def place_of(row_number: int, n_rows: int, seed: int = 0) -> int:
    """Where the shuffle puts a row; ``place_of(r) % shards`` is its shard and ``place_of(r) // shards`` its slot."""
    x = _step(row_number, n_rows, seed)
    while x >= n_rows:
        x = _step(x, n_rows, seed)
    return x


def row_at(place: int, n_rows: int, seed: int = 0) -> int:
    """The row number that the shuffle puts at ``place`` (slot times shards, plus shard)."""
    x = _step_back(place, n_rows, seed)
    while x >= n_rows:
        x = _step_back(x, n_rows, seed)
    return x


def with_places(numbered: DataFrame, n_rows: int, seed: int = 0, row_number: str = "row_number") -> DataFrame:
    """``numbered`` with ``place``, the same as ``place_of``. Row numbers must be below ``n_rows``, at most 2^61.

    A walk leaves the table for at most as many places as the domain has beyond it, so it ends within that many steps;
    nearly all rows need none.
    """
    beyond = math.prod(sides(n_rows)) - n_rows

    def walked(x: Column, steps: int) -> Column:
        step = lambda at, _: F.when(at < n_rows, at).otherwise(_step_column(at, n_rows, seed))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, step)

    out = numbered.withColumn("place", _step_column(F.col(row_number), n_rows, seed))
    for steps in (min(beyond, WALK), beyond if beyond > WALK else 0):
        if steps:
            out = out.withColumn("place", F.when(F.col("place") < n_rows, F.col("place")).otherwise(walked(F.col("place"), steps)))
    return out


def _hashed_alike(kind: DataType) -> bool:
    """Whether Spark hashes values of this type: not those that hold a map or a variant."""
    return not any(word in kind.simpleString() for word in ("map<", "variant"))


def numbered_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None) -> tuple[DataFrame, int]:
    """Rows with ``row_number`` (from 0) in the order of id, text and other columns, and how many there are.

    ``row`` has the columns ``keep`` (default: all). Order: null ids first, then by id; rows of one id by hashes of their
    text and of all columns that Spark can hash. Rows that are equal in all these are put in any order, so each such row
    gets one of the numbers of its equals.

    Sorting goes by range partitions, so an id, or a row repeated as often as a third of the table, is spread over
    many tasks. Only the number of rows of each partition meets in one place.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if _hashed_alike(f.dataType)]
    kept = docs.columns if keep is None else keep
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(None).cast("string").alias("row"),
        F.col(doc_id).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.xxhash64(*hashed).alias("row_hash") if hashed else F.lit(0).cast("long").alias("row_hash"),
        F.monotonically_increasing_id().alias("tie"),
    )
    parts = max(1, -(-docs.count() // RANGE_ROWS))
    order = ["id", "text_hash", "row_hash", "tie"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The number of a row within its partition and that of the partition; written, so that no later run numbers anew.
    at = F.monotonically_increasing_id()
    ranged = written(ranged.drop("text_hash", "row_hash", "tie").withColumn("at", at), "ranged-rows")
    part = F.shiftright("at", 33)
    sizes = written(ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "range-sizes")
    n_parts, n_rows = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each million rows of the table
    starts = sizes.select(F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    met = ranged.join(small(starts, n_parts), part == F.col("of_part"))
    return met.select("row", "id", "size", "text_crc32", (F.col("first") + within).alias("row_number")), n_rows


def shard_rows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 40, seed: int = 0, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """Every row of ``docs`` with its shard and its slot there: ``row`` (columns ``keep``, default all), ``id``, ``size``
    (UTF-8 bytes of the text, null: 0, and 16), ``text_crc32``, ``row_number``, ``shard`` (from 0), ``slot`` (gapless from 0 in each shard).

    Counts of shards differ by one at most, whatever the rows. Null ids, null and repeated rows are rows like others;
    an empty table gives none. Raises ValueError for fewer than one shard.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    rows, n_rows = numbered_rows(docs, doc_id, text, keep)
    places = with_places(rows, n_rows, seed)
    shard = (F.col("place") % shards).cast("int").alias("shard")
    return places.select("row", "id", "size", "text_crc32", "row_number", shard, _div(F.col("place"), shards).alias("slot"))


def write_shards(sharded: DataFrame, folder: str, files: int | None = None) -> None:
    """Write the columns of ``row`` with ``slot`` to ``folder/shard=K``, files in the order of slots; a shard may take several tasks."""
    fields = [f"row.`{c}`" for c in sharded.select("row.*").columns if c not in ("shard", "slot")]
    n_files = files or max(1, -(-sharded.count() // RANGE_ROWS))
    ordered = sharded.select(*fields, "shard", "slot").repartitionByRange(n_files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(folder)
