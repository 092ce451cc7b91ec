"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe and verified pairs.

A hash rotates a unit vector (three rounds of random signs and a fast Hadamard transform) and takes the nearest of the
2 d signed axes. A bucket is k such hashes in a row; each of several tables has its own. In every table a vector stands in its
own bucket and in the likeliest others (some hashes replaced by their next choices, least squared loss of length first).
There are as many tables as it takes to find a pair at the threshold with the asked chance, whatever k and the probes are.
Members of a bucket of which one is at home there are compared in double precision, in blocks of bounded size; a pair that
meets more than once counts where it meets first. So a block returns a few numbers for each of its members, never its pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from steploom.llm.components import components
from steploom.llm.shared import written

#: Mean chance that a pair just at the threshold meets in one of the tables; the chances of pairs differ, so it is above 0.99.
RECALL = 0.995
#: Up to this length the rounds of a rotation are one matrix product, which is quicker.
MATRIX = 512
#: Pairs and tables on which the chance of meeting in one table is measured.
TRIAL_PAIRS, TRIAL_TABLES = 2_000, 8
#: Buckets of a vector in a table, at most, and next choices of a hash that are tried.
MOST_PROBES, CHOICES = 64, 4
#: Unrelated vectors at home in a vector's buckets of one table, at most on average: k is the least that gives so few.
STRANGERS = 1 / 8
#: Members of a block; two blocks are compared at a time.
BLOCK = 256
#: Buckets of up to so many members are compared many at a time.
FEW = 32
#: Bucket numbers travel with a vector modulo this prime: as they are below it, by hash above.
MARKS = 4_294_967_291
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the length is a power of two."""
    x, step = x.copy(), 1
    n = x.shape[1]
    while step < n:
        pairs = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / math.sqrt(n)


@functools.cache
def _replacements(k: int, probes: int, choices: int) -> np.ndarray:
    """Ranks of choices (columns: the k hashes) that can be among so many likeliest ones; the first row is all first choices.

    A row of ranks comes after all rows that are nowhere larger, which are the product of its ranks, counted from one.
    """
    rows = [()]
    for _ in range(k):
        rows = [(*r, c) for r in rows for c in range(choices) if math.prod(x + 1 for x in r) * (c + 1) <= probes]
    return np.array(sorted(rows, key=lambda r: (sum(r), r)))


def cross_polytope(units: np.ndarray, k: int, tables: int, probes: int, seed: int = SEED) -> np.ndarray:
    """Buckets of each vector (rows) in each table (columns): its own, then the likeliest others, no bucket twice."""
    n, dim = units.shape
    size = 1 << max(1, (dim - 1).bit_length())
    random = np.random.default_rng(seed)
    padded = np.zeros((n, size))
    padded[:, :dim] = units
    choices = min(CHOICES, size, probes)
    ranks = _replacements(k, probes, choices)
    stands = np.zeros((n, tables, min(probes, len(ranks))), dtype=np.int64)
    rows = np.arange(n)
    for t in range(tables):
        axes, costs = np.zeros((k, n, choices), dtype=np.int64), np.zeros((n, len(ranks)))
        for j in range(k):
            turned = np.eye(size) if size <= MATRIX else padded
            for _ in range(3):
                turned = hadamard(turned * random.choice([-1.0, 1.0], size))
            if size <= MATRIX:
                turned = padded @ turned
            long = np.abs(turned)
            lost = np.zeros((n, choices))
            for c in range(choices):
                best = long.argmax(axis=1)
                axes[j, :, c] = 2 * best + (turned[rows, best] < 0)
                lost[:, c] = long[rows, best]
                long[rows, best] = -1
            costs += ((lost[:, :1] - lost) ** 2)[:, ranks[:, j]]
        likeliest = costs.argsort(axis=1, kind="stable")[:, : stands.shape[2]]
        for j in range(k):
            stands[:, t] = stands[:, t] * (2 * size) + axes[j][rows[:, None], ranks[likeliest, j]]
    return stands


def probes_of(k: int) -> int:
    """Buckets of a vector in a table: twice as many with each further hash, which about halves the chance of its own one."""
    return min(MOST_PROBES, 1 << (k - 1))


def hashes_needed(dim: int, total: int) -> int:
    """The least k that leaves unrelated vectors, which spread evenly over the buckets, mostly alone."""
    bits = math.log2(2 << max(1, (dim - 1).bit_length()))
    k, most = 1, int(62 / bits)
    while k < most and math.log2(total * probes_of(k)) - k * bits > math.log2(STRANGERS):
        k += 1
    return k


def _member(dim: int, tables: int, probes: int, number: str) -> np.dtype:
    return np.dtype([("key", "<i8"), ("of", "<i8"), ("n", "<i8"), ("e", number, (dim,)), ("marks", "<u4", (tables, probes))])


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(float)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _met(marks_i: np.ndarray, marks_j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of pairs in one table, own one first: whether j stands in the own bucket of i, and i in that of j."""
    return (marks_j == marks_i[:, :1]).any(axis=1), (marks_i == marks_j[:, :1]).any(axis=1)


@functools.cache
def tables_needed(dim: int, k: int, cosine: float, recall: float = RECALL, probes: int | None = None) -> int:
    """Tables after which a pair of this cosine has met with at least this chance.

    The chance of one table is measured on random pairs of exactly this cosine; two standard errors are taken off.
    """
    if dim < 2 or cosine >= 1:
        return 1  # such pairs are parallel and share every bucket
    random = np.random.default_rng(SEED)
    x, other = random.normal(size=(TRIAL_PAIRS, dim)), random.normal(size=(TRIAL_PAIRS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    stands = cross_polytope(np.concatenate([x, y]), k, TRIAL_TABLES, probes or probes_of(k), SEED + 1)
    met = np.stack([np.logical_or(*_met(stands[:TRIAL_PAIRS, t], stands[TRIAL_PAIRS:, t])) for t in range(TRIAL_TABLES)])
    share = met.mean()
    share -= 2 * math.sqrt(share * (1 - share) / met.size)
    if share <= 0:
        raise ValueError(f"pairs of cosine {cosine} hardly ever share a bucket of {k} hashes")
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - share))) if share < 1 else 1


def _count_here(marks: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """For pairs of rows that stand in a bucket of table t: whether they count there, as they meet first in this table and bucket."""
    here = np.ones(len(i), dtype=bool)
    for table in range(int(t.max(initial=-1)) + 1):
        at = np.flatnonzero(here & (t >= table))
        mine, yours = marks[i[at], table], marks[j[at], table]
        in_mine, in_yours = _met(mine, yours)
        now = t[at] == table
        # Both may stand in the own bucket of either; then the smaller one counts.
        place = np.where(in_mine & (~in_yours | (mine[:, 0] <= yours[:, 0])), mine[:, 0], yours[:, 0])
        here[at] = np.where(now, (in_mine | in_yours) & (place == bucket[at]), ~(in_mine | in_yours))
    return here


def _pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs i < j of rows of each group, and the group's number, when groups of these sizes follow each other."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    later = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(group)) - 1
    i = np.repeat(np.arange(len(group)), later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    return i, j, group[i]


def _compare(kinds: dict[int, np.dtype], cosine: float):

    def summed(m: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        """Key, links and smallest row reached of each row that has links."""
        count = np.bincount(i, weights=m["n"][j], minlength=len(m)) + np.bincount(j, weights=m["n"][i], minlength=len(m))
        root = np.arange(len(m))
        while len(i):
            before = root.copy()
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(count)
        return [m["key"][some], count[some].astype(np.int64), m["key"][root[some]]]

    def linked(part: pa.RecordBatch, kind: np.dtype) -> Iterator[list[np.ndarray]]:
        t, bucket, lo, hi = (part.column(c).to_numpy() for c in ("t", "bucket", "lo", "hi"))
        bucket = (bucket % MARKS).astype(np.uint32)
        sizes = pc.list_value_length(part.column("members")).to_numpy()
        dim = kind["e"].shape[0]
        few = sizes <= FEW
        # Small buckets in runs of some millions of numbers, a large one alone.
        pairs = np.where(few, sizes * (sizes - 1) // 2, 0)
        run = np.cumsum(pairs) // max(1, 4_000_000 // dim) + np.cumsum(~few) + np.cumsum(np.r_[False, ~few[:-1]])
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        for a, b in itertools.pairwise([*starts, len(sizes)]):
            rows = part.slice(a, b - a)
            m = np.frombuffer(b"".join(pc.list_flatten(rows.column("members")).to_pylist()), dtype=kind)
            block = pc.list_flatten(rows.column("places")).to_numpy()
            unit = _units(m["e"])
            if few[a]:
                i, j, group = _pairs_within(sizes[a:b])
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                i, j, group = i[near], j[near], group[near]
            else:
                i, j = np.nonzero(unit @ unit.T >= cosine)
                i, j = i[i < j], j[i < j]
                group = np.zeros(len(i), dtype=np.int64)
            # Each pair once: across two blocks, or within the one block of this comparison.
            group = group + a
            once = (m["of"][i] != m["of"][j]) & ((block[i] != block[j]) | (lo[group] == hi[group]))
            i, j, group = i[once], j[once], group[once]
            here = _count_here(m["marks"], i, j, t[group], bucket[group])
            yield summed(m, i[here], j[here])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for found in linked(part, kinds[dim]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["key", "links", "root"])

    return compare


def near_duplicate_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    cosine: float = 0.9,
    tables: int | None = None,
    k: int | None = None,
    recall: float = RECALL,
    probes: int | None = None,
) -> DataFrame:
    """Per row of ``vectors``: ``id``, ``n_links`` (other vectors with at least this cosine), ``component``, the smallest id reachable.

    Vectors that are null, empty, zero or not all finite, and rows of null id, link with nothing; vectors of different lengths
    don't link with each other. Equal vectors are one member with a weight, so copies are counted but never compared. Repeated rows are one vector;
    different vectors of one id are one node with the links of all. Ids are integers. An empty table gives no rows.

    Unless given, k grows with the logarithm of the number of vectors of a length, so that unrelated vectors seldom share a bucket,
    the buckets of a vector in a table (``probes``) double with each hash, and the tables are as many as these, the length and ``cosine`` need for ``recall``.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    finite = ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("id").isNotNull() & F.coalesce(finite & F.exists("e", lambda x: x != 0), F.lit(False))
    classes = rows.filter(good).distinct().groupBy("e").agg(F.min("id").alias("of"), F.count(F.lit(1)).alias("n"))
    # One id may be the smallest of several classes, so each has a key of its own.
    classes = written(classes.select("e", "of", "n", F.monotonically_increasing_id().alias("key")), "vector-classes")
    plans = {}  # hashes per bucket, tables and buckets per table of each length of which there are two vectors or more
    for dim, total in classes.groupBy(F.size("e")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").collect():
        hashes = hashes_needed(dim, total) if k is None else k
        most = probes_of(hashes) if probes is None else probes
        tried = min(most, len(_replacements(hashes, most, min(CHOICES, 1 << max(1, (dim - 1).bit_length()), most))))
        plans[dim] = hashes, tables_needed(dim, hashes, cosine, recall, tried) if tables is None else tables, tried
    # Vectors travel in the numbers they came in and are made double where they are compared.
    number = "<f4" if isinstance(vectors.schema[embedding].dataType.elementType, FloatType) else "<f8"
    kinds = {dim: _member(dim, *shape, number) for dim, (_, *shape) in plans.items()}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("e")).to_numpy()
            for dim in np.unique(lengths).tolist():
                if dim not in plans:
                    continue
                whole = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                for at in range(0, whole.num_rows, 2_000):
                    part = whole.slice(at, 2_000)
                    member = np.zeros(part.num_rows, dtype=kinds[dim])
                    member["e"] = np.array(part.column("e").to_pylist(), dtype=float)
                    for name in ("key", "of", "n"):
                        member[name] = part.column(name).to_numpy()
                    stands = cross_polytope(_units(member["e"]), *plans[dim])
                    member["marks"] = stands % MARKS
                    arrays = [pa.array(member["key"]), pa.array([dim] * len(member), pa.int32()), pa.array([plans[dim][2]] * len(member), pa.int32())]
                    arrays += [pa.array([m.tobytes() for m in member], pa.binary())]
                    arrays += [pa.array(list(stands.reshape(len(member), -1)), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "dim", "probes", "member", "stands"])

    members = written(classes.mapInArrow(hashed, "key long, dim int, probes int, member binary, stands array<long>"), "vector-hashes")
    stands = members.select("key", "dim", "probes", F.posexplode("stands").alias("at", "bucket"))
    stands = stands.select("key", "dim", F.expr("int(at div probes)").alias("t"), "bucket", (F.col("at") % F.col("probes") == 0).alias("home"))
    buckets = stands.groupBy("dim", "t", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("home"))
    buckets = written(buckets.filter("n > 1 AND home").select("dim", "t", "bucket", "n"), "vector-buckets")
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        stands.join(buckets, ["dim", "t", "bucket"])
        .select("key", "dim", "t", "bucket", F.pmod(F.xxhash64("key"), n_blocks).cast("int").alias("block"), n_blocks.alias("blocks"))
        .join(members.select("key", "member"), "key")
        .select("dim", "t", "bucket", "block", "member", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("dim", "t", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "member", "block")
    )
    gathered = (
        dealt.groupBy("dim", "t", "bucket", "lo", "hi")
        .agg(F.collect_list(F.struct("member", "block")).alias("all"))
        .filter(F.size("all") > 1)
        .select("dim", "t", "bucket", "lo", "hi", F.col("all.member").alias("members"), F.col("all.block").alias("places"))
    )
    found = written(gathered.mapInArrow(_compare(kinds, cosine), "key long, links long, root long"), "vector-links")
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    nodes = written(rows.filter(good).distinct().join(classes.select("e", "key"), "e").select("id", "key"), "vector-nodes")
    several = nodes.groupBy("id").agg(F.min("key").alias("root"), F.max("key").alias("last")).filter("root != last")
    of_one_id = nodes.join(several, "id").select("key", "root")
    roots = components(found.select("key", "root").unionAll(of_one_id)).withColumnRenamed("root", "top")
    rooted = classes.select("key", "of", "n").join(linked, "key", "left").join(roots, F.col("key") == F.col("node"), "left")
    rooted = rooted.select("key", "of", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("top", "key").alias("root"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("of").alias("component"))
    result = rooted.join(least, "root").select("key", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component")
    result = written(result, "vector-components")
    nodes = nodes.join(result, "key").groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component").alias("component"))
    return (
        rows.select("id")
        .join(nodes, "id", "left")
        .select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
