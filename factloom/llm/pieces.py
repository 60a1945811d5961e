"""SentencePiece encoding and decoding for merge-type (BPE) models by a score-ordered agenda of adjacent symbol pairs.

A text's symbols start as its characters. The agenda holds every adjacent pair whose concatenation is a piece, best score
first and the leftmost of equals; taking a pair merges it and puts the two new pairs beside it on the agenda. Pairs whose
symbols have changed meanwhile are skipped. A text falls apart where no piece can reach across: into segments (word marks
and what follows) and these into parts between characters that no piece holds side by side. Segments and parts are
held in bounded caches of a worker.

New segments of many texts are encoded side by side: one row of an array each, whose agenda is the row of its pairs' ranks.
Every step takes the best pair of each row and looks up the two pairs beside it, until no row has any left. Long segments,
and new ones that are few, have a heap each instead.

Every segment that a worker encodes anew is checked in the same Arrow batch against the sentencepiece library: its ids, and
its decoded text where it has byte pieces (what each single piece says is checked when the model is read). A difference
fails the task. Segments are independent, so this covers the whole text.

Null text: as the empty one, no ids, empty decoded text. Unknown characters become their UTF-8 bytes. Very long texts:
whole; a stretch without a cut is one agenda, n log n. Null ids, ties and repeated rows: each row by itself. Empty table:
empty result. Extra columns, whatever their names: ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import as_bytes

MARK = "▁"
CACHE_SEGMENTS, CACHE_LENGTH = 600_000, 64
#: New segments of texts of so many characters meet in arrays of so many rows; fewer, or longer ones, take a heap each.
GROUP_CHARS, ROWS, FEW, ROW_LENGTH = 1 << 20, 4096, 32, 32
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")


class PieceCoder:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as spec

        model = spec.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or len(rules.precompiled_charsmap) or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are supported")
        if not model.trainer_spec.byte_fallback or any(p.type in (USER_DEFINED, UNUSED) or MARK in p.piece.lstrip(MARK) for p in model.pieces):
            raise ValueError("only models with byte fallback, without user-defined, unused or inner-mark pieces are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        #: What each id stands for; control ids say nothing.
        self.says = [_said(p.piece, p.type) for p in model.pieces]
        self.is_byte, self.bytes = [p.type == BYTE for p in model.pieces], frozenset(self.byte_ids.values())
        self.marked = [p.type == NORMAL and p.piece.startswith(MARK) for p in model.pieces]
        self.beside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.parts: dict[str, list[int]] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.listed = [f"{i},".encode() for i in range(len(model.pieces))]
        self._pair_slots()
        every = [[i] for i in range(len(model.pieces))]
        if [self.decode(x).decode("utf-8") for x in every] != self.library.decode(every, num_threads=1):
            raise AssertionError("pieces say something else in the library")

    def _pair_slots(self) -> None:
        """Arrays of all pairs of symbols that make a piece: the slot of (left, right) is offset[left] + right if left owns it, else 0."""
        n = len(self.says)
        number = dict(self.ids)
        for c in sorted({c for p in self.score for c in p}):
            number.setdefault(c, n + len(number) - len(self.ids))
        #: The symbol of padding and of characters that no piece holds.
        self.none = n + len(number) - len(self.ids)
        self.symbol_at = np.full(0x110000, self.none, np.int32)
        for symbol, i in number.items():
            if len(symbol) == 1:
                self.symbol_at[ord(symbol)] = i
        self.byte_at = np.array([self.byte_ids[b] for b in range(256)], np.int32)
        place = {x: i for i, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        #: Rank of no pair at all.
        self.last = len(place)
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for piece, x in self.score.items():
            for i in range(1, len(piece)):
                left, right = number.get(piece[:i]), number.get(piece[i:])
                if left is not None and right is not None:
                    rows.setdefault(left, []).append((right, place[x], number[piece]))
        span = 4 * sum(map(len, rows.values())) + 1
        offset = [1] * (self.none + 1)
        owner, rank, makes = ([x] * (span + self.none + 1) for x in (-1, self.last, self.none))
        at = 0
        for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            at = (at + 7919) % span
            while any(owner[1 + at + right] >= 0 for right, _, _ in row):
                at = (at + 7919) % span
            offset[left] = 1 + at
            for right, best, piece in row:
                owner[1 + at + right], rank[1 + at + right], makes[1 + at + right] = left, best, piece
        self.offset, self.owner, self.rank, self.makes = (np.array(x, np.int32) for x in (offset, owner, rank, makes))

    def _slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.offset[left] + right
        return np.where(self.owner[at] == left, at, 0)

    def row_ids(self, rows: list[str]) -> list[list[int]]:
        """Ids of each string, none empty: the agendas of all run side by side, the leftmost best pair of every row at each step."""
        n, size = len(rows), np.fromiter(map(len, rows), np.int64, len(rows))
        width = int(size.max()) + 2  # padding on both sides
        column = np.arange(width)
        inside = (column > 0) & (column <= size[:, None])
        points = np.frombuffer("".join(rows).encode("utf-32-le"), "<u4")
        grid = np.full((n, width), self.none, np.int32)
        grid[inside] = self.symbol_at[points]
        slots = np.zeros((n, width), np.int32)
        slots[:, :-1] = self._slots(grid[:, :-1], grid[:, 1:])
        ranks = self.rank[slots]
        symbol, slot, rank = grid.reshape(-1), slots.reshape(-1), ranks.reshape(-1)
        before, after, going = np.arange(-1, n * width - 1), np.arange(1, n * width + 1), np.arange(n)
        while True:
            left = going * width + (ranks if len(going) == n else ranks[going]).argmin(axis=1)
            more = rank[left] < self.last
            going, left = going[more], left[more]
            if not len(going):
                break
            right, made = after[left], self.makes[slot[left]]
            head, tail = before[left], after[right]
            symbol[left], symbol[right], rank[right] = made, -1, self.last
            after[left], before[tail] = tail, left
            slot[left] = on = self._slots(made, symbol[tail])
            rank[left] = self.rank[on]
            slot[head] = on = self._slots(symbol[head], made)
            rank[head] = self.rank[on]
        live = inside & (grid >= 0)
        ids, length = grid[live], live.sum(axis=1)
        unknown = ids >= len(self.says)
        if unknown.any():
            chars = points[live[inside]]
            size = np.where(unknown, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), 1)
            length = np.add.reduceat(size, np.cumsum(length) - length)
            ids = np.repeat(ids, size)
            spelled = chars[unknown].tobytes().decode("utf-32-le").encode("utf-8")
            ids[np.repeat(unknown, size)] = self.byte_at[np.frombuffer(spelled, np.uint8)]
        flat, ends = ids.tolist(), np.cumsum(length).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def new_ids(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment, by arrays where that pays."""
        short = sorted((s for s in segments if len(s) <= ROW_LENGTH), key=len)
        made: dict[str, list[int]] = {}
        if len(short) >= FEW:
            for i in range(0, len(short), ROWS):
                made.update(zip(rows := short[i : i + ROWS], self.row_ids(rows), strict=True))
        return [made[s] if s in made else self.segment_ids(s) for s in segments]

    def merged(self, part: str) -> list[str]:
        """The symbols left when the agenda is empty."""
        score, symbols = self.score, list(part)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(-score[pair], i, i + 1, 2) for i in range(n - 1) if (pair := part[i : i + 2]) in score]
        heapify(agenda)
        while agenda:
            _, left, right, size = heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            follower = after[left] = after[right]
            if follower >= 0:
                before[follower] = left
            for a, b in ((before[left], left), (left, follower)):
                if a >= 0 and b >= 0 and (pair := symbols[a] + symbols[b]) in score:
                    heappush(agenda, (-score[pair], a, b, len(pair)))
        return [s for s in symbols if s]

    def _part(self, part: str) -> list[int]:
        held = self.parts.get(part)
        if held is None:
            held = []
            for symbol in self.merged(part):
                known = self.ids.get(symbol)
                held.extend([known] if known is not None else [self.byte_ids[b] for b in symbol.encode("utf-8")])
            if len(self.parts) < CACHE_SEGMENTS and len(part) <= CACHE_LENGTH:
                self.parts[part] = held
        return held

    def segment_ids(self, segment: str) -> list[int]:
        beside, start, out = self.beside, 0, []
        for i in range(1, len(segment)):
            if segment[i - 1 : i + 1] not in beside:
                out += self._part(segment[start:i])
                start = i
        return out + self._part(segment[start:])

    def segments(self, text: str) -> list[str]:
        return _SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [x for s in self.segments(text) for x in self.segment_ids(s)]

    def _spelled(self, ids: list[int]) -> bytes:
        """Text of ids as UTF-8, word marks as spaces; bytes that form no character become U+FFFD one by one."""
        out, run = [], []
        for x in [*ids, None]:
            if x is not None and self.is_byte[x]:
                run.append(self.says[x])
                continue
            if run:
                out.append(_characters(b"".join(run)))
                run = []
            if x is not None:
                out.append(self.says[x])
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """The decoded text as UTF-8: the word mark at the start, if any, is the dummy prefix and goes."""
        spelled = self._spelled(ids)
        lead = next((x for x in ids if self.is_byte[x] or self.says[x]), None)
        return spelled[1:] if lead is not None and self.marked[lead] else spelled

    def found(self, segments: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids in decimal, each followed by a comma, and spelled text) of segments; new ones are checked against the library."""
        known = self.known
        out = list(map(known.get, segments))
        if None not in out:
            return out
        new = list(dict.fromkeys([s for s, x in zip(segments, out, strict=True) if x is None]))
        plain = [s[1:] for s in new]
        ids = self.new_ids(new)
        # a segment of the mark alone is the empty text with its prefix, which the library encodes as nothing
        wrong = [s for s, p, x, lib in zip(new, plain, ids, self.library.encode(plain, num_threads=1), strict=True) if x != lib and p]
        # without byte pieces a text is its pieces' texts one after the other, and those were checked when the model was read
        spelled = {s: x for s, x in zip(new, ids, strict=True) if not self.bytes.isdisjoint(x)}
        decoded = {s: self.decode(x) for s, x in spelled.items()}
        wrong += [s for (s, t), back in zip(decoded.items(), self.library.decode(list(spelled.values()), num_threads=1) if spelled else [], strict=True) if t.decode("utf-8") != back]
        if wrong:
            raise AssertionError(f"the agenda and the library differ: {wrong[:3]!r}")
        listed, says = self.listed, self.says
        made = {s: (b"".join([listed[i] for i in x]), b" " + decoded[s] if s in decoded else b"".join([says[i] for i in x])) for s, x in zip(new, ids, strict=True)}
        for s, x in made.items():
            if len(known) >= CACHE_SEGMENTS:
                break
            if len(s) <= CACHE_LENGTH:
                known[s] = x
        return [made[s] if x is None else x for s, x in zip(segments, out, strict=True)]

    def coded(self, texts: Iterable[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids in decimal, each followed by a comma, and decoded text) of each text; texts meet in groups."""
        segments, ends, chars = [], [], 0
        for text in chain(texts, [None]):
            if text is not None:
                segments += self.segments(text)
                ends.append(len(segments))
                chars += len(text)
            if chars >= GROUP_CHARS or text is None:
                found = self.found(segments)
                for a, b in zip([0, *ends], ends, strict=False):
                    yield b"".join([x[0] for x in found[a:b]]), b"".join([x[1] for x in found[a:b]])[1:]
                segments, ends, chars = [], [], 0


def _said(piece: str, kind: int) -> bytes:
    if kind == BYTE:
        return bytes([int(piece[3:5], 16)])
    return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode("utf-8")


def _characters(run: bytes) -> bytes:
    """The run's characters; each byte outside of one becomes U+FFFD."""
    out = []
    while run:
        try:
            run.decode("utf-8")
        except UnicodeDecodeError as e:
            out += [run[: e.start], "\N{REPLACEMENT CHARACTER}".encode()]
            run = run[e.start + 1 :]
        else:
            out.append(run)
            break
    return b"".join(out)


@lru_cache(maxsize=2)
def piece_coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def coded_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) per row: the text encoded, and its ids decoded."""
    spec = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model)
        for batch in batches:
            size, ids_hash, text_hash, ids, decoded = [], [], [], [], []
            for listed, text in coder.coded((raw or b"").decode("utf-8") for raw in as_bytes(batch.column(1))):
                size.append(listed.count(b","))
                ids_hash.append(hashlib.sha256(listed[:-1]).hexdigest())
                text_hash.append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    ids.append([int(x) for x in listed.split(b",")[:-1]])
                    decoded.append(text.decode("utf-8"))
            arrays, names = [batch.column(0), pa.array(size, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = spec.schema["doc_id"].dataType.simpleString()
    return spec.mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)


def decoded_ids(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of lists of ids, whatever made them. Null lists decode to null."""
    spec = coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model)
        for batch in batches:
            texts = [None if x is None else coder.decode(x).decode("utf-8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return spec.mapInArrow(work, f"doc_id {spec.schema['doc_id'].dataType.simpleString()}, decoded string")
