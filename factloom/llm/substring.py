"""Substring dedup over a log-structured fingerprint index.

A window is `WINDOW` consecutive words. Its anchor is the least hash among the `GRAM`-word grams inside it, which
depends on the window's words alone, so equal windows have equal anchors while only about a quarter of all
positions are anchors. The index is a set of immutable runs; a run holds, per bucket (range of the hash), the
sorted anchors of one batch with the smallest document that has each. A batch is combined per task, sorted, and
merge-joined bucket by bucket with every run; anchors met in two documents are hits; then the batch's own run
is added. Runs have levels: `fan_in` runs of one level are merged into one of the next, so an entry is rewritten as often
as there are levels. A manifest beside the runs names those that count; an index opened again starts from it.

Hits are verified: every window of a hit anchor is digested (anchor and a second hash of the 13 words from words hashed
with another seed: 128 bits in all; the words themselves are not compared), and the smallest document of each digest
decides. An index that outlives the call keeps the windows of its documents, which decide with them. Only texts of
documents with hits are shuffled; a bitmap of hashed ids, of at most `FILTER_BITS` bits, tells them from the rest, which
are finished where they are read. Where more documents have hits than the bitmap tells apart, more texts are shuffled.

Hot passages: a task sends each anchor and each digest once, with its smallest document; the other documents of
that task are decided in the task itself. So a passage in a third of all documents costs one entry a task.

Null text: no words. Null id: never earlier than another, so such rows are neither indexed nor cut. Rows that
share an id: each is judged on its own text, none cuts another. Texts under 13 words: no window. Very long texts: whole,
one at a time. Ties and repeated rows: one result each. Empty table: empty result. Extra columns: ignored, or handed
through by `cut_documents`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from factloom.llm.common import as_bytes, drop_path, materialize, new_path, partitions, plan_bytes

WINDOW, GRAM = 13, 7
CHUNK_WORDS = 8_000_000
#: Most bits of the bitmap of documents with hits (8 MB), and bytes of input to a bucket and to a home.
FILTER_BITS, BUCKET_BYTES, HOME_BYTES = 1 << 26, 64 << 20, 32 << 20
ROW = "part int, kind int, doc_id long, a binary, b binary, c binary, d binary"
ENTRY, LOCAL, RUN, HIT, SEEN = range(5)

_ODD = np.random.Generator(np.random.PCG64(20240501)).integers(0, 2**63, 2 * WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPAN = re.compile(rb"[^\x20\x09-\x0D]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(words: np.ndarray, width: int, odd: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        out += words[j : j + len(out)] * odd[j]
    return _mix(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def second_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of the words under another seed, for the windows' digests."""
    return np.fromiter((xxh64_intdigest(w, 1) for w in words), np.uint64, len(words))


def anchors(words: np.ndarray) -> np.ndarray:
    """Anchor of each window (start order); no window: empty."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64)
    grams = _rolled(words, GRAM, _ODD)
    n = len(words) - WINDOW + 1
    low = grams[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(low, grams[j : j + n], out=low)
    return low


def window_hashes(words: np.ndarray) -> np.ndarray:
    return _rolled(words, WINDOW, _ODD[WINDOW:])


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Compressed bytes of an 8-byte or 4-byte array: differences if ascending, then byte planes, then zstd."""
    if ascending and len(values):
        values = np.concatenate([values[:1], values[1:] - values[:-1]])
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype: str, ascending: bool = False) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(dtype).itemsize
    values = np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if ascending else values


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Range of the hash that a key lies in: ascending with it, so a sorted run is cut into runs of buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _home(ids: np.ndarray, parts: int) -> np.ndarray:
    """Partition in which a document and all that is known of it meet."""
    return (_mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


class _Rows:
    """Collects rows of ROW and gives them out as record batches."""

    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), *((c, pa.binary()) for c in "abcd")])

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, part: int, kind: int, doc_id: int | None = None, a: bytes | None = None, b: bytes | None = None, c: bytes | None = None, d: bytes | None = None) -> None:
        self.rows.append((int(part), kind, doc_id, a, b, c, d))

    def split(self, kind: int, parts: np.ndarray, columns: list[tuple[np.ndarray, bool]]) -> None:
        """One row for each part; columns (array, ascending) are ordered by part already."""
        if not len(parts):
            return
        cuts = np.concatenate([[0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.add(parts[s], kind, None, *(pack(x[s:e], up) for x, up in columns))

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)


def _by_home(out: _Rows, kind: int, docs: np.ndarray, keys: np.ndarray, parts: int) -> None:
    home = _home(docs, parts)
    order = np.lexsort((keys, docs, home))
    out.split(kind, home[order], [(docs[order], True), (keys[order], False)])


def _first_windows(low: np.ndarray, win: np.ndarray, me: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows (anchor, hash) with the smallest document of each, in order."""
    order = np.lexsort((me, win, low))
    low, win, me = low[order], win[order], me[order]
    one = np.ones(len(low), bool)
    one[1:] = (low[1:] != low[:-1]) | (win[1:] != win[:-1])
    return low[one], win[one], me[one]


def _entries(docs: DataFrame, buckets: int, parts: int, keep: bool = False) -> DataFrame:
    """Rows of ROW: for each task and bucket its sorted distinct anchors (ENTRY), and hits decided in the task (LOCAL); with `keep` also its distinct windows (SEEN)."""
    spec = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, seen, held
            out = _Rows()
            if keys:
                key, doc = np.concatenate(keys), np.concatenate(ids)
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                key, doc = key[new], doc[new]
                first = np.ones(len(key), bool)
                first[1:] = key[1:] != key[:-1]
                many = np.zeros(len(key), bool)
                many[:-1] |= ~first[1:]
                many |= ~first
                _by_home(out, LOCAL, doc[many], key[many], parts)
                key, doc, flag = key[first], doc[first], many[first].astype(np.uint32)
                out.split(ENTRY, _bucket(key, buckets), [(key, True), (doc, False), (flag, False)])
            if seen:
                low, win, me = _first_windows(*(np.concatenate(x) for x in zip(*seen, strict=True)))
                out.split(SEEN, _bucket(low, buckets), [(low, True), (win, False), (me, False)])
            keys, ids, seen, held = [], [], [], 0
            return out.take()

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = (raw or b"").split()
                if len(words) < WINDOW:
                    continue
                hashes = word_hashes(words)
                every = anchors(hashes)
                low = np.unique(every)
                if keep:
                    seen.append((every, window_hashes(second_hashes(words)), np.full(len(every), doc, np.int64)))
                keys.append(low)
                ids.append(np.full(len(low), doc, np.int64))
                held += len(words)
                if held > (CHUNK_WORDS // 4 if keep else CHUNK_WORDS):
                    yield flush()
        yield flush()

    return spec.mapInArrow(work, ROW)


def _column(table: pa.Table, kind: int, name: str) -> list[bytes]:
    return table.filter(pa.compute.equal(table.column("kind"), kind)).column(name).to_pylist()


def _merge(parts: int):
    """Merge-join of one bucket: the batch's entries against the runs' entries; gives the batch's run and its hits."""

    def work(table: pa.Table) -> pa.Table:
        out, bucket = _Rows(), table.column("part")[0].as_py()
        kinds, ups = table.column("kind").to_pylist(), [table.column(c).to_pylist() for c in "abc"]
        key, doc, flag = [], [], []
        for kind, a, b, c in zip(kinds, *ups, strict=True):
            if kind in (ENTRY, RUN):
                key.append(unpack(a, "u8", True))
                doc.append(unpack(b, "i8"))
                flag.append(unpack(c, "u4") if kind == ENTRY else np.full(len(key[-1]), 2, np.uint32))
        if key:
            key, doc, flag = np.concatenate(key), np.concatenate(doc), np.concatenate(flag)
            order = np.lexsort((doc, key))
            key, doc, flag = key[order], doc[order], flag[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            batch = np.bitwise_or.reduceat((flag < 2).astype(np.uint8), starts) > 0
            last = np.concatenate([starts[1:], [len(key)]]) - 1
            hit = np.repeat(batch & (doc[starts] != doc[last]), sizes) & (flag != 1)
            _by_home(out, HIT, doc[hit], key[hit], parts)
            mine = flag < 2
            k, d = key[mine], doc[mine]
            if len(k):
                one = np.concatenate([[True], k[1:] != k[:-1]])
                out.add(bucket, RUN, None, pack(k[one], True), pack(d[one]))
        return pa.Table.from_batches([out.take()])

    return work


def _compact(table: pa.Table) -> pa.Table:
    out = _Rows()
    key = np.concatenate([unpack(a, "u8", True) for a in table.column("a").to_pylist()])
    doc = np.concatenate([unpack(b, "i8") for b in table.column("b").to_pylist()])
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    one = np.concatenate([[True], key[1:] != key[:-1]])
    out.add(table.column("part")[0].as_py(), RUN, None, pack(key[one], True), pack(doc[one]))
    return pa.Table.from_batches([out.take()])


def _compact_seen(table: pa.Table) -> pa.Table:
    out = _Rows()
    columns = (np.concatenate([unpack(x, t, up) for x in table.column(c).to_pylist()]) for c, t, up in (("a", "u8", True), ("b", "u8", False), ("c", "i8", False)))
    low, win, me = _first_windows(*columns)
    out.add(table.column("part")[0].as_py(), SEEN, None, pack(low, True), pack(win), pack(me))
    return pa.Table.from_batches([out.take()])


class Run(NamedTuple):
    """An immutable run: folders of its anchors and windows below the index (None: no windows kept), level and id range."""

    anchors: str
    windows: str | None
    level: int
    first: int
    last: int


class FingerprintIndex:
    """Runs of anchors under `path` (in the shared folder unless given); batches must come in ascending id order.

    With `keep` each run has its documents' windows beside it (anchor, hash, smallest document: up to 24 bytes a word
    before compression), so that later calls verify hits against documents they don't hold, and a manifest is written after
    each change; the newest whole one is opened again. `size` (bytes of input) sets the buckets and homes of a new index.
    """

    MANIFEST = "anchors string, windows string, level int, first long, last long, buckets int, parts int"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fan_in: int = 4, keep: bool = True, size: int = 0) -> None:
        self.spark, self.path, self.fan_in, self.keep = spark, path or new_path(spark, "index"), fan_in, keep
        self.runs: list[Run] = []
        self.spent: list[str] = []
        stored = sorted(n for n in self._list("") if n.startswith("manifest-") and "_SUCCESS" in self._list(n))
        self.version = int(stored[-1].rsplit("-", 1)[1]) if stored else 0
        rows = spark.read.schema(self.MANIFEST).parquet(f"{self.path}/{stored[-1]}").collect() if stored else []
        self.runs = sorted((Run(*r[:5]) for r in rows), key=lambda r: r.first)
        known = rows[0]["buckets"] if rows else None
        if known and buckets not in (None, known):
            raise ValueError(f"the index at {self.path} has {known} buckets")
        self.buckets = known or buckets or max(32, partitions(spark), min(1 << 14, size // BUCKET_BYTES))
        # two homes to a task at least: their sizes even out, and a task holds one home at a time
        self.parts = rows[0]["parts"] if rows else max(32, 2 * partitions(spark), min(1 << 14, size // HOME_BYTES))

    def _list(self, below: str) -> list[str]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}".rstrip("/"))
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def _rows(self, folders: list[str], kind: int) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(*[f"{self.path}/{f}" for f in folders]).withColumn("kind", F.lit(kind))

    @property
    def last(self) -> int | None:
        """Greatest id indexed so far."""
        return max((r.last for r in self.runs), default=None)

    def add(self, docs: DataFrame) -> DataFrame:
        """Hits of one batch against the index and itself, as rows of ROW by the documents' home; the batch's run is added."""
        first, last = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
        if first is None:
            return self.spark.createDataFrame([], ROW)
        if self.runs and first <= self.last:
            raise ValueError(f"id {first} isn't after the indexed ids (up to {self.last})")
        self.compact()
        name = f"batch-{new_path(self.spark, 'b').rsplit('-', 1)[1]}"
        _entries(docs, self.buckets, self.parts, self.keep).write.partitionBy("kind").parquet(f"{self.path}/{name}/map")
        mapped = self.spark.read.schema(ROW).parquet(f"{self.path}/{name}/map")
        entries = mapped.where(F.col("kind") == ENTRY)
        if self.runs:
            entries = entries.unionByName(self._rows([r.anchors for r in self.runs], RUN))
        entries.repartition(self.buckets, "part").groupBy("part").applyInArrow(_merge(self.parts), ROW).write.partitionBy("kind").parquet(f"{self.path}/{name}/out")
        drop_path(self.spark, f"{self.path}/{name}/map/kind={ENTRY}")
        if f"kind={RUN}" in self._list(f"{name}/out"):  # a batch without any window leaves no run behind
            self.runs.append(Run(f"{name}/out/kind={RUN}", f"{name}/map/kind={SEEN}" if self.keep else None, 0, first, last))
            self._note()
        self.spent += [f"{self.path}/{name}/out/kind={HIT}", f"{self.path}/{name}/map/kind={LOCAL}"]
        out = self.spark.read.schema(ROW).parquet(f"{self.path}/{name}/out").where(F.col("kind") == HIT)
        return out.unionByName(mapped.where(F.col("kind") == LOCAL))

    def windows(self) -> DataFrame | None:
        """Windows of all documents so far, as rows of ROW (SEEN) by bucket."""
        kept = [r.windows for r in self.runs if r.windows]
        return self._rows(kept, SEEN) if kept else None

    def forget_hits(self) -> None:
        """Delete the hits of past batches; their DataFrames can't be read any more."""
        for path in self.spent:
            drop_path(self.spark, path)
        self.spent = []

    def _note(self) -> None:
        if self.keep:
            self.version += 1
            rows = [(*r, self.buckets, self.parts) for r in self.runs]
            self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest-{self.version:09d}")

    def compact(self) -> None:
        """Merge the runs of each full level into one of the next; the old ones go once a manifest names the new one."""
        level = 0
        while level <= max((r.level for r in self.runs), default=-1):
            old = [r for r in self.runs if r.level == level]
            if len(old) >= self.fan_in:
                tag = new_path(self.spark, "m").rsplit("-", 1)[1]
                self._rows([r.anchors for r in old], RUN).repartition(self.buckets, "part").groupBy("part").applyInArrow(_compact, ROW).write.parquet(f"{self.path}/merged-{tag}")
                kept = [r.windows for r in old if r.windows]
                if kept:
                    self._rows(kept, SEEN).repartition(self.buckets, "part").groupBy("part").applyInArrow(_compact_seen, ROW).write.parquet(f"{self.path}/seen-{tag}")
                new = Run(f"merged-{tag}", f"seen-{tag}" if kept else None, level + 1, min(r.first for r in old), max(r.last for r in old))
                self.runs = sorted([r for r in self.runs if r.level != level] + [new], key=lambda r: r.first)
                self._note()
                for folder in [*(r.anchors for r in old), *kept]:
                    drop_path(self.spark, f"{self.path}/{folder}")
            level += 1


def _id_filter(hits: DataFrame, docs: int) -> np.ndarray:
    """Bitmap of the hashed ids of all documents in `hits`, four bits a document of the call, at most FILTER_BITS."""
    bits = min(FILTER_BITS, 1 << max(10, (4 * docs).bit_length()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits >> 6, np.uint64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                at = _mix(np.unique(unpack(packed, "i8", True)).view(np.uint64)) & np.uint64(bits - 1)
                np.bitwise_or.at(held, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used].view(np.int64))], ["word", "bits"])

    found = hits.select("a").mapInArrow(work, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _met(ids: pa.Array, bitmap: np.ndarray) -> np.ndarray:
    """Whether each id may have hits; null ids have none."""
    at = _mix(ids.fill_null(0).to_numpy(False).astype(np.int64).view(np.uint64)) & np.uint64(64 * len(bitmap) - 1)
    return ids.is_valid().to_numpy(False) & (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0)


def _spec(docs: DataFrame, carry: list[str]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(carry)])


def _packed(docs: DataFrame, parts: int, carry: list[str], sent: Broadcast) -> DataFrame:
    """Documents that may have hits as rows of ROW by their home (text compressed in `a`), followed by the columns to hand through."""
    spec = _spec(docs, carry)
    extra = spec.schema.fields[2:]
    schema = f"{ROW}" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in extra)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch = batch.filter(pa.array(_met(batch.column(0), sent.value)))
            ids, texts, n = batch.column(0), as_bytes(batch.column(1)), batch.num_rows
            home = _home(ids.to_numpy(False), parts) if n else np.zeros(0, np.int64)
            blank = pa.nulls(n, pa.binary())
            packed = pa.array([None if t is None else small.compress(t) for t in texts], pa.binary())
            base = [pa.array(home.astype(np.int32)), pa.array(np.full(n, ENTRY, np.int32)), ids, packed, blank, blank, blank]
            yield pa.RecordBatch.from_arrays([*base, *batch.columns[2:]], [*_Rows.schema.names, *(f.name for f in extra)])

    return spec.mapInArrow(work, schema)


def _untouched(docs: DataFrame, carry: list[str], with_text: bool, sent: Broadcast, schema: str) -> DataFrame:
    """Results of the documents without hits, finished where they are read."""
    names = ["doc_id", "n_words", "n_removed", "kept_text" if with_text else "kept_sha256", *(f"x{i}" for i in range(len(carry)))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~_met(batch.column(0), sent.value)))
            words = [(t or b"").split() for t in as_bytes(batch.column(1))]
            last = batch.column(1) if with_text else pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())
            counts = pa.array(map(len, words), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(np.zeros(len(words), np.int64)), last, *batch.columns[2:]], names)

    return _spec(docs, carry).mapInArrow(work, schema)


def _hit_windows(parts: int, buckets: int):
    """Digests of the windows of hit anchors in one home partition; those with a smaller document there are settled."""

    def work(table: pa.Table) -> pa.Table:
        out, kinds = _Rows(), table.column("kind").to_numpy()
        raws = {c: table.column(c) for c in "ab"}
        doc, key = [], []
        for i in np.flatnonzero(kinds != ENTRY).tolist():
            doc.append(unpack(raws["a"][i].as_py(), "i8", True))
            key.append(unpack(raws["b"][i].as_py(), "u8"))
        if not doc:
            return pa.Table.from_batches([out.take()])
        doc, key = np.concatenate(doc), np.concatenate(key)
        order = np.argsort(doc, kind="stable")
        doc, key = doc[order], key[order]
        big = zstandard.ZstdDecompressor()
        ids = table.column("doc_id")
        got: list[list[np.ndarray]] = [[], [], [], [], []]
        for i in np.flatnonzero(kinds == ENTRY).tolist():
            me, raw = ids[i].as_py(), raws["a"][i].as_py()
            if me is None or raw is None:
                continue
            s, e = np.searchsorted(doc, me), np.searchsorted(doc, me, "right")
            if s == e:
                continue
            text = big.decompress(raw)
            words = text.split()
            low = anchors(word_hashes(words))
            at = np.flatnonzero(np.isin(low, key[s:e]))
            for x, y in zip(got, (low[at], window_hashes(second_hashes(words))[at] if len(at) else low[:0], np.full(len(at), me, np.int64), np.full(len(at), zlib.crc32(text), np.uint32), at.astype(np.uint32)), strict=True):
                x.append(y)
        if not got[0]:
            return pa.Table.from_batches([out.take()])
        low, win, me, tag, at = (np.concatenate(x) for x in got)
        order = np.lexsort((me, win, low))
        low, win, me, tag, at = (x[order] for x in (low, win, me, tag, at))
        starts = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (win[1:] != win[:-1])])) if len(low) else np.zeros(0, np.int64)
        least = np.repeat(me[starts], np.diff(np.concatenate([starts, [len(low)]])))
        later = me > least
        _settled(out, LOCAL, me[later], tag[later], at[later], parts)
        open_ = ~later
        out.split(ENTRY, _bucket(low[open_], buckets), [(low[open_], True), (win[open_], False), (me[open_], False), (tag[open_].astype(np.uint64) << np.uint64(32) | at[open_].astype(np.uint64), False)])
        return pa.Table.from_batches([out.take()])

    return work


def _settled(out: _Rows, kind: int, doc: np.ndarray, tag: np.ndarray, at: np.ndarray, parts: int) -> None:
    home = _home(doc, parts)
    order = np.lexsort((at, tag, doc, home))
    out.split(kind, home[order], [(doc[order], True), (tag[order], False), (at[order], False)])


def _decide(parts: int):
    """Windows of one bucket that also start in a smaller document."""

    def work(table: pa.Table) -> pa.Table:
        out = _Rows()
        kinds = table.column("kind").to_pylist()
        if ENTRY not in kinds:
            return pa.Table.from_batches([out.take()])
        low, win, me = (np.concatenate([unpack(x, t, up) for x in table.column(c).to_pylist()]) for c, t, up in (("a", "u8", True), ("b", "u8", False), ("c", "i8", False)))
        # windows of the index (SEEN) have no place in a text of this call
        sizes = [len(unpack(a, "u8", True)) if kind == SEEN else 0 for kind, a in zip(kinds, table.column("a").to_pylist(), strict=True)]
        spot = np.concatenate([np.zeros(n, np.uint64) if kind == SEEN else unpack(d, "u8") for kind, n, d in zip(kinds, sizes, table.column("d").to_pylist(), strict=True)])
        here = np.concatenate([np.zeros(n, bool) if kind == SEEN else np.ones(len(unpack(d, "u8")), bool) for kind, n, d in zip(kinds, sizes, table.column("d").to_pylist(), strict=True)])
        order = np.lexsort((me, win, low))
        low, win, me, spot, here = low[order], win[order], me[order], spot[order], here[order]
        starts = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (win[1:] != win[:-1])]))
        least = np.repeat(me[starts], np.diff(np.concatenate([starts, [len(low)]])))
        later = here & (me > least)
        _settled(out, LOCAL, me[later], (spot[later] >> np.uint64(32)).astype(np.uint32), spot[later].astype(np.uint32), parts)
        return pa.Table.from_batches([out.take()])

    return work


def _cut(text: bytes, gone: np.ndarray) -> bytes:
    """`text` without the words marked, and without the white space before each of them."""
    out, at = [], 0
    for word, cut in zip(_SPAN.finditer(text), gone.tolist(), strict=True):
        if not cut:
            out.append(text[at : word.end()])
        at = word.end()
    return b"".join(out).lstrip()


def _finish(carry: int, with_text: bool):
    """Each document of one home partition with its repeated words removed."""

    def work(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        doc, tag, at = [], [], []
        for i in np.flatnonzero(kinds != ENTRY).tolist():
            doc.append(unpack(table.column("a")[i].as_py(), "i8", True))
            tag.append(unpack(table.column("b")[i].as_py(), "u4"))
            at.append(unpack(table.column("c")[i].as_py(), "u4"))
        doc, tag, at = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((doc, np.int64), (tag, np.uint32), (at, np.uint32)))
        order = np.argsort(doc, kind="stable")
        doc, tag, at = doc[order], tag[order], at[order]
        rows = table.filter(pa.array(kinds == ENTRY))
        big = zstandard.ZstdDecompressor()
        n_words, n_removed, digests, texts = [], [], [], []
        for me, raw in zip(rows.column("doc_id").to_pylist(), rows.column("a").to_pylist(), strict=True):
            text = b"" if raw is None else big.decompress(raw)
            words = text.split()
            gone = None
            if me is not None:
                s, e = np.searchsorted(doc, me), np.searchsorted(doc, me, "right")
                if s < e and len(spots := at[s:e][tag[s:e] == zlib.crc32(text)]):
                    marks = np.zeros(len(words) + 1, np.int32)
                    np.add.at(marks, spots, 1)
                    np.add.at(marks, spots + WINDOW, -1)
                    gone = np.cumsum(marks[:-1]) > 0
            n_words.append(len(words))
            n_removed.append(0 if gone is None else int(gone.sum()))
            if with_text:
                texts.append(raw if raw is None else text if gone is None else _cut(text, gone))
            else:
                left = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
        last = pa.array(texts, pa.binary()).cast(pa.string()) if with_text else pa.array(digests, pa.string())
        names = ["doc_id", "n_words", "n_removed", "kept_text" if with_text else "kept_sha256", *(f"x{i}" for i in range(carry))]
        return pa.table([rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), last, *(rows.column(f"x{i}") for i in range(carry))], names=names)

    return work


def in_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """`docs` in ascending ranges of doc_id of about equal counts."""
    if batches < 2:
        return [docs]
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    cuts = sorted(set(cuts or []))
    edges = list(zip([None, *cuts], [*cuts, None], strict=True))
    return [docs.where((F.lit(True) if lo is None else F.col("doc_id") > lo) & (F.lit(True) if hi is None else F.col("doc_id") <= hi)) for lo, hi in edges]


def remove_repeats(docs: DataFrame, batches: int = 3, with_text: bool = False, carry: tuple[str, ...] = (), index: FingerprintIndex | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 or kept_text, x0..) per row of `docs`; x are the `carry` columns.

    Documents go into the index in `batches` ascending id ranges; the verification then runs once over all hits. What
    `index` holds from earlier calls cuts these documents too, and their ids must come after it. An index of this call
    alone has levels of two runs, so that three batches meet a compacted one, and is deleted when its hits are verified.
    """
    spark, own, carry = docs.sparkSession, index is None, list(carry)
    index = index or FingerprintIndex(spark, keep=False, fan_in=2, size=plan_bytes(docs))
    parts, buckets = index.parts, index.buckets
    hits = None
    for batch in in_batches(docs, batches):
        found = index.add(batch.select("doc_id", "text"))
        hits = found if hits is None else hits.unionByName(found)
    sent = spark.sparkContext.broadcast(_id_filter(hits, docs.count()))
    at = new_path(spark, "windows")
    packed = _packed(docs.select("doc_id", "text"), parts, [], sent)
    packed.unionByName(hits).repartition(partitions(spark), "part").groupBy("part").applyInArrow(_hit_windows(parts, buckets), ROW).write.partitionBy("kind").parquet(at)
    index.forget_hits()
    windows = spark.read.schema(ROW).parquet(at)
    open_, past = windows.where(F.col("kind") == ENTRY), index.windows()
    open_ = open_ if past is None else open_.unionByName(past)
    decided = open_.repartition(buckets, "part").groupBy("part").applyInArrow(_decide(parts), ROW)
    settled = materialize(windows.where(F.col("kind") == LOCAL).unionByName(decided), "settled")
    drop_path(spark, at)
    if own:
        drop_path(spark, index.path)
    whole = _packed(docs, parts, carry, sent)
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in whole.schema.fields[7:])
    schema = f"doc_id long, n_words long, n_removed long, {'kept_text' if with_text else 'kept_sha256'} string{extra}"
    both = whole.unionByName(settled, allowMissingColumns=True)
    cut = both.repartition(partitions(spark), "part").groupBy("part").applyInArrow(_finish(len(carry), with_text), schema)
    return _untouched(docs, carry, with_text, sent, schema).unionByName(cut)


def cut_documents(docs: DataFrame, batches: int = 3) -> DataFrame:
    """`docs` (columns of documents) with repeated words cut out of the texts; rows that lose every word go."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = remove_repeats(docs, batches, True, tuple(carry)).where("n_removed = 0 OR n_removed < n_words")
    back = {c: F.col(f"x{i}") for i, c in enumerate(carry)}
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(back["n_chars"])
    return found.select(*[F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id") if c == "doc_id" else F.col("kept_text").alias("text") if c == "text" else back[c].alias(c) for c in docs.columns])
