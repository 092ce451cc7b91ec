"""Token ids in binary files: ids ranked by frequency, byte-aligned variable-length coding with separate control bytes.

A rank takes 1 to 4 bytes, least significant first; a control byte holds the lengths less 1 of four ranks, two bits each,
the first lowest. All numbers are little-endian. A file is a run of blocks:

    b"LOOMTOK1", documents (u8), tokens (u8), bytes of data (u8),
    per document: id (i8), tokens (u8), 1 if the id is null else 0 (u1),
    control bytes (tokens / 4, rounded up), data bytes

Files, in ``files``, are numbered in the order of the documents; ``ranks`` beside it holds the id of each rank, ``manifest`` the
documents and tokens of each file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steploom.llm.shared import small, written
from steploom.llm.tokens import batch_encoder

MAGIC = b"LOOMTOK1"
#: Tokens of a file and of a block, about: what a task holds at a time.
FILE_TOKENS = 1 << 23
BLOCK_TOKENS = 1 << 19

#: The byte lengths that each control byte stands for.
LENGTHS = np.array([[(control >> 2 * k & 3) + 1 for k in range(4)] for control in range(256)], dtype=np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2^32."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    widest = int(ranks.max(initial=0))
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    more = padded[: len(ranks)]
    for k in range(1, 4):
        if widest >> 8 * k:
            more += ranks >= 1 << 8 * k
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    ends = np.cumsum(more, dtype=np.int64) + np.arange(1, len(ranks) + 1)
    starts = ends - more - 1
    data = np.empty(int(ends[-1]) if len(ranks) else 0, dtype=np.uint8)
    data[starts] = ranks.astype(np.uint8)
    for k in range(1, 4):
        if widest >> 8 * k:
            longer = np.flatnonzero(more >= k)
            data[starts[longer] + k] = (ranks[longer] >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` ranks: lengths by table lookup, then each byte where its length has it."""
    lengths = LENGTHS[control].reshape(-1)[:count]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
    out = padded[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= padded[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(keys: list[int | None], parts: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    counts = np.array([len(p) for p in parts], dtype="<u8")
    control, data = encode_ranks(rank_of[np.concatenate(parts)])
    null = np.array([k is None for k in keys], dtype=np.uint8)
    ids = np.array([0 if k is None else k for k in keys], dtype="<i8")
    sizes = np.array([len(keys), counts.sum(), len(data)], dtype="<u8")
    return b"".join([MAGIC, sizes.tobytes(), ids.tobytes(), counts.tobytes(), null.tobytes(), control, data])


def unpack_blocks(content: bytes, id_of: np.ndarray) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """For each block: document ids, tokens per document, and the token ids of all of them."""
    at = 0
    while at < len(content):
        if content[at : at + 8] != MAGIC:
            raise ValueError("not a block of a token file")
        docs, tokens, size = (int(x) for x in np.frombuffer(content, "<u8", 3, at + 8))
        at += 32
        ids = np.frombuffer(content, "<i8", docs, at)
        counts = np.frombuffer(content, "<u8", docs, at + 8 * docs).astype(np.int64)
        null = np.frombuffer(content, np.uint8, docs, at + 16 * docs)
        at += 17 * docs
        width = -(-tokens // 4)
        control = np.frombuffer(content, np.uint8, width, at)
        data = np.frombuffer(content, np.uint8, size, at + width)
        at += width + size
        yield [None if n else int(k) for k, n in zip(ids, null, strict=True)], counts, id_of[decode_ranks(control, data, tokens)]


def _narrow(ids: bytes) -> bytes:
    """32-bit ids in 16 bits each, if all fit."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else ids


def _wide(ids: bytes, count: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * count else "<u4")


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """The ids of all rows, those of several rows in one array, which ends with the row that brings it to ``BLOCK_TOKENS``."""
    parts, held = [], 0
    for batch in batches:
        for n, blob in zip(batch["n"], batch["ids"], strict=True):
            parts.append(_wide(blob, n))
            held += n
            if held >= BLOCK_TOKENS:
                yield np.concatenate(parts)
                parts, held = [], 0
    if parts:
        yield np.concatenate(parts)


def _file_system(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    file_tokens: int = FILE_TOKENS,
) -> None:
    """Tokenise whole texts (null: empty), append ``end_id`` to each, and write them to ``folder`` in order of the id.

    ``folder`` is in a store that all executors reach. Null ids come first; rows of one id stand together, in order of
    their tokens' checksum. An empty table writes no token file. A task writes its file beside the place and then renames
    it, so a task that runs twice leaves one whole file. Ids are integers.
    """

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = batch_encoder(tokenizer), np.uint32(end_id).tobytes()
        for batch in batches:
            at = 0
            for found in encode(batch.column("text")):
                part = batch.slice(at, len(found))
                at += len(found)
                blobs = [ids + end for ids in found]
                sums, sizes = [zlib.crc32(b) for b in blobs], [len(b) // 4 for b in blobs]
                narrow = pa.array([_narrow(b) for b in blobs], pa.binary())
                columns = [part.column("id"), pa.array(sums, pa.int64()), pa.array(sizes, pa.int64()), narrow]
                yield pa.RecordBatch.from_arrays(columns, ["id", "crc", "n", "ids"])

    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    tokens = written(source.mapInArrow(tokenise, "id long, crc long, n long, ids binary"), "tokens")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, dtype=np.int64)
        for ids in _together(batches):
            seen = np.bincount(ids)
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), dtype=np.int64)])
            total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pd.DataFrame({"token": used, "n": total[used]})

    counts = tokens.select("n", "ids").mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    ranked = counts.toPandas().sort_values(["n", "token"], ascending=[False, True])  # at most the vocabulary
    id_of = ranked["token"].to_numpy(dtype="<u4")
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, dtype="<u4")
    rank_of[id_of] = np.arange(len(id_of), dtype="<u4")
    files, root = _file_system(folder)
    files.create_dir(f"{root}/files", recursive=True)
    with files.open_output_stream(f"{root}/ranks") as out:
        out.write(id_of.tobytes())

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        name = f"tokens-{context.partitionId():08d}.bin"
        files, root = _file_system(folder)
        draft = f"{root}/files/.{name}-{context.taskAttemptId()}"
        out, keys, parts, held = None, [], [], 0
        docs = total = 0

        def flush() -> None:
            nonlocal out, keys, parts, held
            out = out or files.open_output_stream(draft)
            out.write(pack_block(keys, parts, rank_of))
            keys, parts, held = [], [], 0

        for batch in batches:
            for null, key, n, blob in zip(batch["id"].isna(), batch["id"], batch["n"], batch["ids"], strict=True):
                keys.append(None if null else int(key))
                parts.append(_wide(blob, n))
                held, docs, total = held + len(parts[-1]), docs + 1, total + len(parts[-1])
                if held >= BLOCK_TOKENS:
                    flush()
        if keys:
            flush()
        if out:
            out.close()
            files.move(draft, f"{root}/files/{name}")
            yield pd.DataFrame({"file": [name], "docs": [docs], "tokens": [total]})

    n_files = max(1, -(-int(tokens.agg(F.sum("n")).head()[0] or 0) // file_tokens))
    # The id is a whole number of up to 64 bits; as text beside a null it keeps every digit in pandas.
    dealt = tokens.repartitionByRange(n_files, "id", "crc").sortWithinPartitions("id", "crc")
    dealt.select(F.col("id").cast("string").alias("id"), "n", "ids").mapInPandas(write, "file string, docs long, tokens long").write.parquet(
        f"{folder}/manifest"
    )


def read_token_files(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """Per document, from the files: ``id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, ``ids``."""
    manifest = spark.read.schema("file string, docs long, tokens long").parquet(f"{folder}/manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file of millions of tokens
    base = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _file_system(folder)
        with files.open_input_stream(f"{root}/ranks") as f:
            id_of = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                start = 0
                for keys, counts, ids in unpack_blocks(content, id_of):
                    ends = np.cumsum(counts)
                    parts = [ids[e - n : e] for e, n in zip(ends, counts, strict=True)]
                    out = pd.DataFrame(
                        {
                            "file": path.rpartition("/")[2],
                            "id": pd.array(keys, dtype="Int64"),
                            "start": start + ends - counts,
                            "n_tokens": counts,
                            "ids_crc32": [zlib.crc32(p.astype("<u4").tobytes()) for p in parts],
                        }
                    )
                    if keep_ids:
                        out["ids"] = [p.astype("i4") for p in parts]
                    start += int(counts.sum())
                    yield out

    schema = "file string, id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    found = spark.read.format("binaryFile").load(f"{folder}/files").select("path", "content").mapInPandas(read, schema)
    rest = ["n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]
    return found.join(small(base, manifest.count()), "file").select("id", (F.col("base") + F.col("start")).alias("start"), *rest)
