"""Embedding by a remote provider: bounded requests from inside the tasks, answers matched by index, finished slices kept.

Texts go out in requests of at most `REQUEST` texts, at most `in_flight` of them at a time from one task. Overload, server
errors and lost connections are tried again after growing pauses; anything else, a wrong number of vectors or mixed
dimensions end the job. Vectors live in a versioned table under the fingerprint of their text and model, so a text is sent
once, a second run sends only what is missing, and a model of another dimension is refused.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import strip
from factloom.sources.commits import VersionedTable

#: Texts of a request, and the statuses that are worth another try.
REQUEST, AGAIN = 10, (408, 429, 500, 502, 503, 504)
STORE = "embedding_id string, embedding array<double>"


class Upstream(Exception):
    """A provider's failure; `status` is None where there was no answer."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


def json_post(endpoint: str, key: str, model: str, timeout: float = 30) -> Callable[[list[str]], dict]:
    """A function that posts texts and gives the parsed answer."""

    def post(texts: list[str]) -> dict:
        headers = {"Authorization": f"Bearer {key}", "Content-Type": "application/json; charset=utf-8"}
        request = urllib.request.Request(endpoint, json.dumps({"model": model, "input": texts}).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            raise Upstream(f"HTTP {e.code}", e.code) from e
        except (OSError, TimeoutError) as e:
            raise Upstream(f"no answer: {e}") from e
        except ValueError as e:
            raise Upstream("the answer is no JSON", 200) from e

    return post


def vectors_of(answer: dict, n: int, dimension: int | None = None) -> list[list[float]]:
    """The vectors of an answer in the order of the request; items without an index keep their place."""
    items = answer.get("data") if isinstance(answer, dict) else None
    if not isinstance(items, list) or len(items) != n:
        raise Upstream(f"{n} texts, but {len(items) if isinstance(items, list) else 'no'} vectors", 200)
    try:
        placed = sorted(((x["index"] if isinstance(x.get("index"), int) else i, [float(v) for v in x["embedding"]]) for i, x in enumerate(items)), key=lambda p: p[0])
    except (TypeError, KeyError, ValueError, AttributeError) as e:
        raise Upstream("an item without a vector of numbers", 200) from e
    sizes = {len(v) for _, v in placed}
    if len(sizes) != 1 or 0 in sizes or dimension not in (None, *sizes):
        raise Upstream(f"vectors of dimension {sorted(sizes)}, wanted {dimension or 'one'}", 200)
    return [v for _, v in placed]


def persistent(post: Callable[[list[str]], dict], texts: list[str], dimension: int | None, tries: int, pause: float) -> list[list[float]]:
    for attempt in range(tries):
        try:
            return vectors_of(post(texts), len(texts), dimension)
        except Upstream as e:
            if (e.status is not None and e.status not in AGAIN) or attempt == tries - 1:
                raise
            time.sleep(pause * 2**attempt)
    raise AssertionError("no try was made")


def fingerprint(text: Column, model: str, provider: str) -> Column:
    """Provider, a digest of the model and one of the text, lower-cased with its white space squeezed; blank texts fail the job."""
    plain = strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    checked = F.when(plain != "", plain).otherwise(F.raise_error(F.lit("a blank text has no vector")))
    return F.concat(F.lit(f"oae-{provider}-m{hashlib.sha256(model.encode()).hexdigest()[:8]}-"), F.substring(F.sha2(checked, 256), 1, 16))


def _sent(texts: DataFrame, post: Callable[[list[str]], dict], dimension: int | None, in_flight: int, tries: int, pause: float) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque = deque()

        def answered() -> pa.RecordBatch:
            ids, future = waiting.popleft()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(future.result(), pa.list_(pa.float64()))], ["embedding_id", "embedding"])

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                ids, listed = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at in range(0, len(ids), REQUEST):
                    if len(waiting) == in_flight:
                        yield answered()
                    waiting.append((ids[at : at + REQUEST], pool.submit(persistent, post, listed[at : at + REQUEST], dimension, tries, pause)))
            while waiting:
                yield answered()

    return texts.select("embedding_id", "text").mapInArrow(work, STORE)


def embedded_remotely(
    chunks: DataFrame, store: VersionedTable, post: Callable[[list[str]], dict], model: str, provider: str = "ds", dimension: int | None = None,
    slices: int = 8, in_flight: int = 4, tries: int = 5, pause: float = 0.5, tasks: int = 4,
) -> DataFrame:
    """Chunks (..., text) with `embedding_id` and `embedding`; texts without a vector in `store` are sent, a slice and a commit at a time.

    At most tasks * in_flight requests are under way. A run that fails leaves its finished slices; the next one sends the rest.
    """
    named = chunks.withColumn("embedding_id", fingerprint(F.col("text"), model, provider))
    for i in range(slices):
        some = named.where(F.pmod(F.xxhash64("embedding_id"), F.lit(slices)) == i).groupBy("embedding_id").agg(F.min("text").alias("text"))
        missing = some.join(store.read().select("embedding_id"), "embedding_id", "left_anti").repartition(tasks, "embedding_id")
        if not missing.isEmpty():
            store.upsert(_sent(missing, post, dimension, in_flight, tries, pause))
    return named.join(store.read(), "embedding_id", "left")
