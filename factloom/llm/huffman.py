"""Token ids as files: canonical length-limited Huffman codes in independent blocks.

Layout of a written dataset: `codes` (one row: code length of each id, limited to `LIMIT` bits) and `blocks`, a
Parquet table with one row per block: shard and block number, the documents' ids and token counts, the bit
offset of every `STRIDE`-th symbol, and the bit stream. Shards are ascending ranges of doc_id, blocks ascend inside a
shard, documents inside a block, so the ids of all documents stand in ascending doc_id order. Spark's own writer
puts the rows there, so any file system it knows will do and a lost task is written again.

A block decodes on its own by a table of 2**LIMIT entries; its bit-offset checkpoints let all strides decode side by side.

Texts are encoded once: the ids are stored in the width that the vocabulary needs, counted, put in doc_id order and then
packed, so that the second pass shuffles compressed ids and not texts.

Null or empty text: the end id alone. Null ids come first. Ties: equal doc_ids stay side by side, in the order of the
texts' first 16 bytes, then of their ids as stored. Repeated rows: stored each. Very long texts: whole; a block ends after the document that
fills it. Empty table: no blocks. Extra columns: ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import as_bytes, drop_table, materialize, new_path, partitions
from factloom.llm.tokens import as_ids, grouped, word_encoder

LIMIT, STRIDE, BLOCK_TOKENS, END_ID = 20, 1024, 1 << 20, 2
BLOCK = "shard int, block int, doc_ids array<long>, n_tokens array<int>, checkpoints array<long>, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of each symbol (0: unused) by package-merge, none above `limit`."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of the limit")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaves, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        by = np.argsort(both, kind="stable")
        leaves.append(by < len(weights))
        merged = both[by]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    need, lengths = 2 * len(order) - 2, np.zeros(len(order), np.uint8)
    for leaf in reversed(leaves):
        taken = int(leaf[:need].sum())
        lengths[:taken] += 1
        need = 2 * (need - taken)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol, given by (length, symbol)."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        symbols = np.flatnonzero(lengths == length)
        code <<= length - last
        last = length
        codes[symbols] = code + np.arange(len(symbols), dtype=np.uint64)
        code += len(symbols)
    return codes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """The bit stream (big-endian 32-bit words and two words of padding) and its checkpoints."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    word, shift = start >> 5, (64 - (start & 31) - size).astype(np.uint64)
    value = codes[ids] << shift
    n = (int(end[-1]) >> 5) + 3 if len(ids) else 2
    # codes don't overlap, so sums of parts are exact in doubles
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return words.astype(np.uint64).astype(">u4").tobytes(), start[::stride]


def decode_block(payload: bytes, checkpoints: np.ndarray, total: int, table: np.ndarray, limit: int = LIMIT, stride: int = STRIDE) -> np.ndarray:
    """All ids of a block; every stride is a lane, and a step decodes one symbol of each lane."""
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    lanes, at = len(checkpoints), checkpoints.astype(np.int64).copy()
    out = np.zeros((stride, lanes), np.uint32)
    last = total - (lanes - 1) * stride  # symbols of the last lane
    mask, low = np.uint64((1 << limit) - 1), 64 - limit
    for step in range(min(stride, total)):
        n = lanes if step < last else lanes - 1
        pos = at[:n]
        i = pos >> 5
        seen = (words[i] << np.uint64(32) | words[i + 1]) >> (low - (pos & 31)).astype(np.uint64) & mask
        found = table[seen]
        out[step, :n] = found >> np.uint32(8)
        pos += (found & np.uint32(255)).astype(np.int64)
    return out.T.ravel()[:total] if lanes else out.ravel()[:0]


def decode_table(lengths: np.ndarray, codes: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Entry of each `limit`-bit prefix: symbol << 8 | length."""
    table = np.zeros(1 << limit, np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.left_shift(1, limit - lengths[order].astype(np.int64))
    table[: int(spans.sum())] = np.repeat(order.astype(np.uint32) << np.uint32(8) | lengths[order], spans)
    return table


def encoded_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, head, width, ids): each text's ids and `end_id` in numbers of `width` bytes; head, the text's start, orders ties."""
    spec = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, narrow=end_id < 1 << 16)
        end = as_ids([end_id], encoder.width)
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            for s, e in grouped(texts):
                ids = pa.array([data + end for data in encoder.encode(texts[s:e])], pa.binary())
                heads = pa.array([t[:16] for t in texts[s:e]], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[s:e], heads, pa.array(np.full(e - s, encoder.width, np.int32)), ids], ["doc_id", "head", "width", "ids"])

    return spec.mapInArrow(work, "doc_id long, head binary, width int, ids binary")


def token_totals(encoded: DataFrame) -> np.ndarray:
    """Global count of each id. The driver holds one number per vocabulary entry, however large the corpus."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            width, stored = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, e in grouped(stored):
                found = np.bincount(np.frombuffer(b"".join(stored[s:e]), f"<u{width[s]}"), minlength=len(counts))
                found[: len(counts)] += counts
                counts = found
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    table = encoded.select("width", "ids").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    totals = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    totals[ids] = n
    return totals


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, limit: int = LIMIT, block_tokens: int = BLOCK_TOKENS, stride: int = STRIDE) -> None:
    """Write the ids of all documents, each followed by `end_id`, in ascending doc_id order under `path`."""
    spark = docs.sparkSession
    encoded = materialize(encoded_ids(docs, tokenizer, end_id), "ids")
    lengths = code_lengths(token_totals(encoded), limit)
    spark.createDataFrame([(lengths.tobytes(), limit, stride)], "lengths binary, bits int, stride int").coalesce(1).write.parquet(f"{path}/codes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes = canonical(lengths)
        shard, block, tokens = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, held, tokens
            payload, marks = encode_block(np.concatenate([x[1] for x in held]), lengths, codes, stride)
            row = [[shard], [block], [[x[0] for x in held]], [[len(x[1]) for x in held]], [marks.tolist()], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            block, held, tokens = block + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["shard", "block", "doc_ids", "n_tokens", "checkpoints", "payload"])

        for batch in batches:
            for doc, width, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((doc, np.frombuffer(data, f"<u{width}")))
                tokens += len(held[-1][1])
                if tokens >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    first = F.col("doc_id").asc_nulls_first()
    ordered = encoded.repartitionByRange(partitions(spark), first).sortWithinPartitions(first, "head", "ids")
    ordered.select("doc_id", "width", "ids").mapInArrow(work, BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_table(encoded)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) per document, decoded from the files under `path`."""
    code = spark.read.parquet(f"{path}/codes").first()
    lengths, limit, stride = np.frombuffer(bytes(code["lengths"]), np.uint8), code["bits"], code["stride"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths, canonical(lengths), limit)
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, docs, sizes, marks, payload = (batch.column(i)[row] for i in range(6))
                sizes = np.array(sizes.as_py(), np.int64)
                data = decode_block(payload.as_py(), np.array(marks.as_py(), np.int64), int(sizes.sum()), table, limit, stride).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                spans = [data[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
                n = len(sizes)
                arrays = [pa.array(docs.as_py(), pa.int64()), pa.array([shard.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32()), pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                names = ["doc_id", "shard", "block", "inside", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(spans, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    rows = blocks.mapInArrow(work, "doc_id long, shard int, block int, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    sizes = blocks.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # two levels: one row per shard meets in one task (as many as there are partitions), blocks only inside their shard
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("b", inside).select("shard", "block", "b").join(shards.withColumn("s", before).select("shard", "s"), "shard").select("shard", "block", (F.col("s") + F.col("b")).alias("base"))
    out = rows.join(starts, ["shard", "block"]).withColumn("start", F.col("base") + F.col("inside"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def stored_ids(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the ids of `docs` and read them back."""
    path = path or new_path(docs.sparkSession, "ids")
    write_ids(docs, tokenizer, path)
    return read_ids(docs.sparkSession, path)
