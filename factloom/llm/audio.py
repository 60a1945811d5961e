"""Media columns: chroma audio fingerprints and their alignment.

Samples become pitch-class frames (a windowed Fourier transform folded into twelve classes, smoothed and normalised);
sixteen box filters over the frames' integral image, each quantised to two bits, pack into one 32-bit integer a
frame. A recording is a sequence of such integers. Two recordings are aligned at every offset at which integers agree,
and accepted by the share of differing bits over the overlap at the best offset. The overlap is at least `min_overlap`,
or the whole of the shorter one.

Search: a stated query set against all rows. Queries go out in blocks of at most `BLOCK` recordings (a fixed size, so the
broadcast is bounded), and each row is matched against a block through the block's sorted integers, in its own task:
no shuffle, no pairs but the accepted ones. Equal integers in one task are matched once. Recall against comparing
every offset of every pair is measured in the tests (0.9 at least).

Null, empty or too short recordings: no integers, no match; so with media that can't be read (24-bit samples too).
Null ids: never a query, and left out of the result by recording. Repeated rows: pairs for each; by recording, rows of
one id share one result over all their different media, each counted once. Ties: offsets of equal error by votes, then the
smaller. Very long recordings: whole. Empty table: empty result. Extra columns: ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialize

CLASSES, FRAME, HOP, SMOOTH = 12, 1024, 256, (0.25, 0.75, 1.0, 0.75, 0.25)
LOW_HZ, HIGH_HZ = 110.0, 1760.0
BLOCK = 2048
MIN_OVERLAP, MAX_ERROR = 48, 0.2
#: Low bits that may differ when integers are looked up; alignment counts all 32.
LOOSE = np.uint32(8)
#: Integers aligned at a time.
ALIGN = 1 << 20


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the sixteen box filters, by rule: each kind at four places and widths."""
    return [(kind, (5 * kind + 3 * i) % 8, 4 - 2 * (i % 2) if kind else 3, (4, 8, 12, 16)[i]) for kind in range(4) for i in range(4)]


WIDTH = max(f[3] for f in filters())
EDGES = (-0.18, 0.0, 0.18)


def wav_samples(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and the rate of a PCM wave file; ValueError if it can't be read."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError) as e:
        raise ValueError("not a PCM wave file") from e
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw[: len(raw) // width * width], f"<i{width}").astype(np.float64) / 2 ** (8 * width - 1)
    else:
        raise ValueError("unsupported sample width")
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate


def tone_row(values: np.ndarray, rate: int = 4000, seconds: float = 0.128) -> tuple[np.ndarray, int]:
    """A vector heard as a melody: value i is note i, twelve classes over the middle of its range, one octave by its sign."""
    values = np.nan_to_num(np.asarray(values, np.float64))
    scale = np.sqrt(np.mean(values**2)) or 1.0
    note = np.clip(np.floor((values / scale + 2) * 3), 0, 11)
    hz = 220.0 * 2 ** (note / 12)
    n = round(rate * seconds)
    step = 2 * np.pi * np.repeat(hz, n) / rate
    phase = np.cumsum(step)
    return 0.6 * np.sin(phase) + 0.3 * np.sin(2 * phase), rate


def chroma(samples: np.ndarray, rate: int, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Normalised pitch-class frames, (frames, 12)."""
    if len(samples) < frame:
        return np.zeros((0, CLASSES))
    hz = np.fft.rfftfreq(frame, 1 / rate)
    use = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    pitch = np.round(12 * np.log2(hz[use] / 440.0)).astype(np.int64) % CLASSES
    fold = np.zeros((int(use.sum()), CLASSES))
    fold[np.arange(len(pitch)), pitch] = 1.0
    view = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    power = np.abs(np.fft.rfft(view * np.hanning(frame), axis=1)[:, use]) ** 2
    frames = power @ fold
    if len(frames) < len(SMOOTH):
        return np.zeros((0, CLASSES))
    kernel = np.array(SMOOTH) / sum(SMOOTH)
    frames = sum(k * frames[i : len(frames) - len(SMOOTH) + 1 + i] for i, k in enumerate(kernel))
    norm = np.linalg.norm(frames, axis=1, keepdims=True)
    return np.where(norm > 1e-6, frames / np.maximum(norm, 1e-12), 0.0)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """One packed integer for each position of the widest filter."""
    frames = chroma(samples, rate)
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, CLASSES + 1))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def box(t0: np.ndarray, t1: np.ndarray, c0: int, c1: int) -> np.ndarray:
        return image[t1, c1] - image[t0, c1] - image[t1, c0] + image[t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, h, w in filters():
        end, mid, half = at + w, at + w // 2, c + h // 2
        whole = box(at, end, c, c + h)
        if kind == 0:
            a, b = whole, box(at, end, 0, CLASSES) * h / CLASSES
        elif kind == 1:
            a, b = box(at, end, c, half), box(at, end, half, c + h)
        elif kind == 2:
            a, b = box(at, mid, c, c + h), box(mid, end, c, c + h)
        else:
            a, b = box(at, mid, c, half) + box(mid, end, half, c + h), box(at, mid, half, c + h) + box(mid, end, c, half)
        value = np.log((1.0 + a) / (1.0 + b))
        level = np.searchsorted(EDGES, value).astype(np.uint32)
        out = out << np.uint32(2) | level ^ level >> np.uint32(1)  # Gray code: neighbouring levels differ in one bit
    return out


def align(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Overlap and share of differing bits when b's frame j stands at a's frame j + offset."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 1.0
    return hi - lo, float(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum()) / (32 * (hi - lo))


class QueryBlock:
    """Queries' integers, sorted, with the query and position of each."""

    def __init__(self, queries: list[tuple[int, np.ndarray]]) -> None:
        self.ids, self.prints = [q for q, _ in queries], [p for _, p in queries]
        codes = np.concatenate(self.prints) >> LOOSE if queries else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(queries)), [len(p) for p in self.prints]) if queries else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(p)) for p in self.prints]) if queries else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.owner, self.place = codes[order], owner[order], place[order]
        self.line = np.concatenate(self.prints) if queries else codes
        self.sizes = np.array([len(p) for p in self.prints], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def matches(self, row: np.ndarray, min_overlap: int, max_error: float) -> list[tuple[int, int, int, float]]:
        """(query, offset, overlap, bit error) of each query that aligns with `row`, at its offset of least error."""
        seen = row >> LOOSE
        lo, hi = np.searchsorted(self.codes, seen), np.searchsorted(self.codes, seen, "right")
        counts = hi - lo
        total = int(counts.sum())
        if not total:
            return []
        at = np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(total)
        mine = np.repeat(np.arange(len(row)), counts)
        span = 1 << 32
        key = self.owner[at].astype(np.int64) * span + (self.place[at] - mine) + span // 2
        keys, votes = np.unique(key, return_counts=True)
        owner, offset = keys // span, keys % span - span // 2
        # one vote is enough to try an offset: the low bits may differ in all other places
        start, end = np.maximum(offset, 0), np.minimum(self.sizes[owner], len(row) + offset)
        overlap = end - start
        tried = np.flatnonzero(overlap >= np.minimum(min_overlap, np.minimum(self.sizes[owner], len(row))))
        errors = np.ones(len(keys))
        cuts = np.searchsorted(np.cumsum(overlap[tried]), np.arange(ALIGN, int(overlap[tried].sum()) + 1, ALIGN), "right")
        for some in np.split(tried, np.unique(cuts)):
            if len(some):
                n = overlap[some]
                firsts = np.cumsum(n) - n
                i = np.arange(int(n.sum())) + np.repeat(start[some] - firsts, n)
                bits = np.bitwise_count(self.line[i + np.repeat(self.begins[owner[some]], n)] ^ row[i - np.repeat(offset[some], n)])
                errors[some] = np.add.reduceat(bits, firsts, dtype=np.int64) / (32 * n)
        good = tried[errors[tried] <= max_error]
        order = good[np.lexsort((offset[good], -votes[good], errors[good], owner[good]))]
        best = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])] if len(order) else order
        return [(self.ids[int(owner[i])], int(offset[i]), int(overlap[i]), float(errors[i])) for i in best]


def audio_fingerprints(df: DataFrame, id_col: str, media_col: str, decode: Callable[[object], tuple[np.ndarray, int]] = wav_samples) -> DataFrame:
    """(rec_id, codes) per row: the packed integers as little-endian bytes; undecodable media give none."""
    spec = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(media_col).alias("media"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                try:
                    out.append(b"" if value is None else fingerprint(*decode(value)).astype("<u4").tobytes())
                except ValueError:
                    out.append(b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rec_id", "codes"])

    return spec.mapInArrow(work, "rec_id long, codes binary")


def match_recordings(prints: DataFrame, every: int = 20, min_overlap: int = MIN_OVERLAP, max_error: float = MAX_ERROR, block: int = BLOCK) -> DataFrame:
    """(rec_id, n_links, best_query, best_offset, best_overlap, best_error): one row per recording, also of those without a match.

    A recording counts all queries that align with it and names the one of least bit error (then of least id). The count
    is made in the task that matches it, so what leaves a task grows with the recordings, not with the pairs.
    """
    found = _search(prints, every, min_overlap, max_error, block, False)
    least = F.min(F.when(F.col("best_query").isNotNull(), F.struct("best_error", "best_query", "best_offset", "best_overlap")))
    rows = found.groupBy("rec_id").agg(F.sum("n_links").alias("n_links"), least.alias("b"))
    return rows.select("rec_id", "n_links", "b.best_query", "b.best_offset", "b.best_overlap", "b.best_error")


def find_recordings(prints: DataFrame, every: int = 20, min_overlap: int = MIN_OVERLAP, max_error: float = MAX_ERROR, block: int = BLOCK) -> DataFrame:
    """(query_id, rec_id, offset, overlap, bit_error): rows that align with a query, a row whose id `every` divides, itself excepted."""
    return _search(prints, every, min_overlap, max_error, block, True)


def _search(prints: DataFrame, every: int, min_overlap: int, max_error: float, block: int, pairs: bool) -> DataFrame:
    spark = prints.sparkSession
    prints = materialize(prints if pairs else prints.where("rec_id IS NOT NULL").dropDuplicates(["rec_id", "codes"]), "prints")
    asked = prints.where(F.col("rec_id") % every == 0).where(F.length("codes") > 0)
    blocks = max(1, -(-asked.count() // block))
    place = F.pmod(F.xxhash64("rec_id"), F.lit(blocks))
    names = ["query_id", "rec_id", "offset", "overlap", "bit_error"] if pairs else ["rec_id", "n_links", "best_query", "best_offset", "best_overlap", "best_error"]
    found = None
    for i in range(blocks):
        part = asked.where(place == i).distinct().orderBy("rec_id").toArrow()
        queries = [(q, np.frombuffer(c, "<u4")) for q, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
        sent = spark.sparkContext.broadcast(queries)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, seen = QueryBlock(sent.value), {}
            for batch in batches:
                rows = []
                for rec, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hits = seen.get(codes) if codes else []
                    if hits is None:
                        hits = index.matches(np.frombuffer(codes, "<u4"), min_overlap, max_error)
                        if len(seen) < 10_000:
                            seen[codes] = hits
                    hits = [(round(e, 6), q, o, n) for q, o, n, e in hits if q != rec]
                    if pairs:
                        rows.extend((q, rec, o, n, e) for e, q, o, n in hits)
                    else:
                        e, q, o, n = min(hits, default=(None, None, None, None))
                        rows.append((rec, len(hits), q, o, n, e))
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                kinds = [*[pa.int64()] * (len(names) - 1), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        hits = prints.mapInArrow(work, ", ".join(f"{n} long" for n in names[:-1]) + f", {names[-1]} double")
        found = hits if found is None else found.unionByName(hits)
    return found
