"""Token counts by prefix dynamic programming for SentencePiece BPE models.

The last token of a prefix's encoding decides the rest: the encoding of a prefix is the encoding of the prefix
before its last token, plus that token. So the table of counts follows from one pass: at each prefix the pieces that
end there are tried, and the one that the merge rules keep apart from the token before it is the last token.
No merge can span two neighbouring characters that no piece holds side by side, so text falls apart there: into
segments (word marks and what follows them) and these into parts, whose tables are independent and are cached as the
steps from each prefix's count to the next; a text's table is the running sum of its segments' steps.

A table answers any truncation or budget question about its text without encoding again. Unknown characters
count a token for each UTF-8 byte, as byte fallback does. Null or empty text: 0 tokens, 0 bytes, not over the limit. Very
long texts: whole, one table at a time. Null ids are kept. Ties and repeated rows: each row by itself. Empty table: empty
result. Extra columns, whatever their names: ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import as_bytes

MARK = "▁"
CACHE_SEGMENTS = 500_000
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
NORMAL, USER_DEFINED = 1, 4


class PrefixCounter:
    """Counts of tokens at every prefix, exact for identity-normalised BPE models with a dummy prefix."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as spec

        model = spec.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or len(rules.precompiled_charsmap) or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only BPE models with identity normalisation are supported")
        if any(p.type == USER_DEFINED or MARK in p.piece.lstrip(MARK) for p in model.pieces):
            raise ValueError("pieces with an inner word mark or user-defined symbols are not supported")
        self.dummy = MARK if rules.add_dummy_prefix else ""
        self.bytes_of = (lambda c: len(c.encode())) if model.trainer_spec.byte_fallback else (lambda c: 1)
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.longest = max(map(len, self.score))
        self.beside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.steps: dict[str, bytes] = {}
        self.part_steps: dict[str, bytes] = {}
        self.apart: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The merge rules, plainly: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays_apart(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            known = self.apart[pair] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def table(self, part: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, 2, ... characters."""
        n, score, apart = len(part), self.score, self.apart
        last, count = [""] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                token = part[j:i]
                if token in score or j == i - 1:
                    pair = (last[j], token)
                    known = apart.get(pair)
                    if known or known is None and self.stays_apart(*pair):
                        last[i] = token
                        count[i] = count[j] + (1 if token in score else self.bytes_of(token))
                        break
            else:
                raise AssertionError("a prefix without an encoding")
        return count

    def segment_steps(self, segment: str) -> bytes:
        """Change of the count at each character, a signed byte each."""
        beside, cuts = self.beside, [0]
        cuts += [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in beside]
        out, held = [], self.part_steps
        for s, e in zip(cuts, [*cuts[1:], len(segment)], strict=True):
            part = segment[s:e]
            steps = held.get(part)
            if steps is None:
                count = self.table(part)
                steps = np.diff(np.array(count)).astype(np.int8).tobytes()
                if len(held) < CACHE_SEGMENTS and len(part) <= 64:
                    held[part] = steps
            out.append(steps)
        return b"".join(out)

    def prefix_table(self, text: str) -> np.ndarray:
        """Entry i: tokens of the text's first i characters."""
        if not text:
            return np.zeros(1, np.int64)
        line = self.dummy + text.replace(" ", MARK)
        segments = _SEGMENT.findall(line)
        if not line.startswith(MARK):
            segments.insert(0, line[: len(line) - sum(map(len, segments))])
        held = self.steps
        parts = [held.get(s) for s in segments]
        if None in parts:
            for i, x in enumerate(parts):
                if x is None:
                    s = segments[i]
                    x = parts[i] = held.get(s) or self.segment_steps(s)
                    if len(held) < CACHE_SEGMENTS and len(s) <= 64:
                        held[s] = x
        whole = np.cumsum(np.frombuffer(b"".join(parts), np.int8), dtype=np.int64)
        return np.concatenate([[0], whole[len(self.dummy) :]])


def fits(table: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens."""
    return int(np.flatnonzero(table <= budget)[-1])


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_table: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars[, prefix_counts]) per row; fit_chars: longest prefix within `limit`."""
    spec = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(model)
        for batch in batches:
            size, total, fit, tables = [], [], [], []
            for raw in as_bytes(batch.column(1)):
                table = counter.prefix_table((raw or b"").decode("utf-8"))
                size.append(len(raw or b""))
                total.append(int(table[-1]))
                fit.append(fits(table, limit))
                if with_table:
                    tables.append(table.tolist())
            arrays = [batch.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array([t > limit for t in total], pa.bool_()), pa.array(fit, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if with_table:
                arrays.append(pa.array(tables, pa.list_(pa.int32())))
                names.append("prefix_counts")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = spec.schema["doc_id"].dataType.simpleString()
    return spec.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_counts array<int>" * with_table)
