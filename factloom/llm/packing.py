"""Packing by Karmarkar-Karp multiway differencing.

Documents are tokenized once and cut into whole windows, one piece of whole `unit`s and a rest under `unit`
tokens. Pieces fall into groups of about `GROUP_PIECES` by a hash, and each group is packed on its own: the two
partial partitions with the largest imbalances are merged, large loads of one against small loads of the other,
until one partition into k near-equal windows is left. If a window exceeds the capacity, k rises and the group is
packed again. Groups bound memory and time per task at any corpus size and cost a fraction of a window each.

Null or empty text: the end id alone. Null ids are kept. Ties and repeated rows: packed once each, in the order of length,
id, place and checksum; rows alike in all of these are dealt to groups by their number in their task. Very long texts: whole, a piece for each window. Empty
table: empty result. Extra columns: ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import as_bytes, materialize, partitions
from factloom.llm.tokens import grouped, word_encoder

CAPACITY, UNIT, END_ID = 2048, 512, 1
GROUP_PIECES = 4096


def cuts(n: int, capacity: int, unit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    out = [(at, capacity) for at in range(0, n - n % capacity, capacity)]
    at, rest = n - n % capacity, n % capacity
    if whole := rest - rest % unit:
        out.append((at, whole))
    if rest % unit:
        out.append((at + whole, rest % unit))
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID, with_ids: bool = False, numbered: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids][, nth]): every piece of every document; nth: rows of its id and ids before it in its task."""
    spec = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        seen: Counter[tuple] = Counter()
        for batch in batches:
            texts, names = [t or b"" for t in as_bytes(batch.column(1))], batch.column(0).to_pylist() if numbered else []
            for s, e in grouped(texts):
                at, start, length, crc, total, ids, nth = [], [], [], [], [], [], []
                for i, data in enumerate(encoder.encode(texts[s:e]), s):
                    data += end
                    n = len(data) // 4
                    if numbered:
                        row = (names[i], n, zlib.crc32(data))
                        seen[row] += 1
                    for a, k in cuts(n, capacity, unit):
                        piece = data[4 * a : 4 * (a + k)]
                        at.append(i)
                        start.append(a)
                        length.append(k)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            ids.append(piece)
                        if numbered:
                            nth.append(seen[row] - 1)
                arrays = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                arrays += [pa.array(ids, pa.binary())] * with_ids + [pa.array(nth, pa.int64())] * numbered
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids + ["nth"] * numbered)

    kind = spec.schema["doc_id"].dataType.simpleString()
    return spec.mapInArrow(work, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids + ", nth long" * numbered)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window of each item: a partition into k windows of near-equal sums."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    following, tail = np.full(n, -1, np.int64), np.arange(n)
    # a partial partition: loads ascending, less their minimum, and the first item of each window (-1: empty)
    heap = [(-int(s), i, None) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    serial = n

    def opened(entry: tuple) -> tuple[np.ndarray, np.ndarray]:
        if entry[2] is not None:
            return entry[2]
        loads, heads = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        loads[-1], heads[-1] = -entry[0], entry[1]
        return loads, heads

    while len(heap) > 1:
        one, two = heapq.heappop(heap), heapq.heappop(heap)
        if one[2] is not None and two[2] is None or one[2] is not None and two[2] is not None:
            one, two = two, one
        if one[2] is None and two[2] is not None:  # a single item meets a partition: its window is the least loaded
            loads, heads = two[2]
            item, load = one[1], int(loads[0]) - one[0]
            if heads[0] >= 0:
                following[tail[heads[0]]] = item
                tail[heads[0]] = tail[item]
                item = heads[0]
            to = int(np.searchsorted(loads, load)) - 1
            if load <= loads[0]:
                to = 0
            loads[:to], heads[:to] = loads[1 : to + 1].copy(), heads[1 : to + 1].copy()
            loads[to], heads[to] = load, item
        else:
            (a, x), (b, y) = opened(one), opened(two)
            loads, y = a + b[::-1], y[::-1]
            both = (x >= 0) & (y >= 0)
            following[tail[x[both]]] = y[both]
            tail[x[both]] = tail[y[both]]
            heads = np.where(x >= 0, x, y)
            order = np.argsort(loads, kind="stable")
            loads, heads = loads[order], heads[order]
        loads -= loads[0]
        heapq.heappush(heap, (-int(loads[-1]), serial, (loads, heads)))
        serial += 1
    heads = opened(heap[0])[1]
    window = np.empty(n, np.int64)
    for w, item in enumerate(heads.tolist()):
        while item >= 0:
            window[item] = w
            item = int(following[item])
    return window


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item; the number of windows rises until none exceeds the capacity."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        window = differencing(sizes, k)
        worst = int(np.bincount(window, weights=sizes, minlength=k).max()) if len(sizes) else 0
        if worst <= capacity:
            return window
        over = worst - total / k
        k = max(k + 1, int(np.ceil(total / max(1.0, capacity - over))) if over < capacity / 8 else k + max(1, k // 64))


def pack_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece."""
    spark = docs.sparkSession
    rows = materialize(pieces(docs, tokenizer, capacity, unit, end_id, numbered=True), "pieces")
    groups = max(1, -(-rows.count() // group_pieces))
    # rows alike in all that they hold go to different groups by their number
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "nth"), F.lit(groups)).alias("group")

    def pack(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        table = table.take(order)
        sizes = table.column("length").to_numpy()
        whole = sizes == capacity
        window = np.empty(len(sizes), np.int64)
        window[whole] = np.arange(int(whole.sum()))
        window[~whole] = windows_of(sizes[~whole], capacity) + int(whole.sum())
        by = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[by])
        first = np.concatenate([[True], window[by][1:] != window[by][:-1]])
        base = np.repeat((ends - sizes[by])[first], np.diff(np.concatenate([np.flatnonzero(first), [len(by)]])))
        table = table.take(pa.array(by))
        sequence = pa.array((table.column("group").to_numpy() << 32) + window[by])
        return table.drop_columns(["group"]).append_column("sequence_id", sequence).append_column("offset", pa.array(ends - sizes[by] - base))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "nth") + ", sequence_id long, offset long"
    return rows.select(*[c for c in rows.columns if c != "nth"], spread).repartition(partitions(spark), "group").groupBy("group").applyInArrow(pack, schema)
