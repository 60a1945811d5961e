"""A text index of immutable segments for exact BM25 top lists.

A segment holds, for a batch of documents, postings in blocks: one row per (term, shard) with at most the documents of
one shard, its greatest term frequency and its least length. A shard is a run of documents of one task, so building a segment
shuffles nothing; files are sorted by term, so scans skip row groups. Adding a batch adds a segment; deleting or replacing
documents adds a segment of tombstones and of negative document counts. Nothing is rewritten; the list of segments is a
commit log, so readers keep the version that they opened.

A search scores a query's rarest terms first: the k-th best of what they bring is a threshold. Terms whose greatest
contributions sum to less can't bring a document into the list on their own, so blocks of terms that only such queries ask for are
opened only in shards where some query has another term. Queries go out in blocks; opened blocks meet by shards, once for all queries of a block,
and a task scores a group of shards at a time and keeps each query's k best, so what is shuffled is the postings and short lists,
never a row for each pair of a query and a document. The list is exact.

Documents are named by their id: null ids are left out, of repeated ids in a batch the greatest text counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.sources.commits import CommitLog
from factloom.sources.staging import dropped, staged

#: The public Okapi parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents of a shard (a set of them is the bits of a long), shards that a compaction numbers together, terms that a search hands to the scan as a predicate.
SHARD_DOCS, SHARDS_TOGETHER, FEW_TERMS = 64, 1024, 200
#: Rounding of scores and what bounds may be off by it.
PLACES, SLACK = 6, 2e-6
#: Queries sent out at a time, shards scored at a time, and scores that a task holds at a time.
QUERY_BLOCK, GROUP_SHARDS, SCORES = 2048, 64, 1 << 22


def _weight(tf: Column, length: Column, mean_length: float) -> Column:
    """What a term of weight one adds to a document's score."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean_length)))


class SegmentIndex:
    """Documents (doc, text) under `path`, searchable at the version that this object opened; `refresh` opens the latest one."""

    def __init__(self, spark: SparkSession, path: str, doc_type: str = "bigint") -> None:
        self.spark, self.path, self.doc_type, self.log = spark, path.rstrip("/"), doc_type, CommitLog(spark, path)
        self.version, self.manifest = self.log.latest()

    def refresh(self) -> SegmentIndex:
        self.version, self.manifest = self.log.latest()
        return self

    def _segments(self) -> list[dict]:
        return self.manifest.get("segments", [])

    def _union(self, kind: str, schema: str) -> DataFrame:
        """Rows of one kind of all segments, with the number of the segment."""
        out = None
        for s in self._segments():
            if kind in s["kinds"]:
                part = self.spark.read.schema(schema).parquet(f"{self.path}/{s['name']}/{kind}").withColumn("seg", F.lit(s["seq"]))
                out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], f"{schema}, seg int") if out is None else out

    def _blocks(self) -> DataFrame:
        return self._union("raw", self._block_schema()).where("term IS NOT NULL")

    def docs(self) -> DataFrame:
        """(doc, length, shard, seg) of live documents."""
        return self._live(self._union("docs", f"doc {self.doc_type}, length int, shard long"))

    def _tombstones(self) -> DataFrame | None:
        if not any("dead" in s["kinds"] for s in self._segments()):
            return None
        return self._union("dead", f"doc {self.doc_type}").groupBy("doc").agg(F.max("seg").alias("until"))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (doc, seg, ...) that no later tombstone names. A replacing batch carries its tombstones itself."""
        dead = self._tombstones()
        return rows if dead is None else rows.join(dead, "doc", "left").where("until IS NULL OR seg >= until").drop("until")

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> SegmentIndex:
        """Add a batch as one segment; documents whose ids are already there are replaced."""
        batch = docs.select(F.col(doc_id).cast(self.doc_type).alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL")
        name, n, rows, total = self._segment(batch)
        if n != rows:
            _delete(self.spark, f"{self.path}/{name}")
            name, n, rows, total = self._segment(batch.groupBy("doc").agg(F.max("text").alias("text")))
        return self._commit({"name": name, "kinds": ["docs", "raw", "lexicon"], "n": n, "total": total})

    def _segment(self, batch: DataFrame) -> tuple[str, int, int, int]:
        """Write the postings of (doc, text); (name, distinct documents, rows, tokens)."""
        name = f"seg-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        cores = self.spark.sparkContext.defaultParallelism
        if len(batch.inputFiles()) < cores:  # few files are few tasks; a corpus of many files stays where it is
            batch = batch.repartition(cores)
        bag = batch.select("doc", T.tokens(F.col("text")).alias("tokens"))
        bag.mapInArrow(_inverted, self._block_schema()).sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{at}/raw")
        raw = self.spark.read.schema(self._block_schema()).parquet(f"{at}/raw")
        self._write(raw.where("term IS NOT NULL"), raw.where("term IS NULL").select("shard", F.explode("postings").alias("p")).select("p.doc", "p.length", "shard"), at)
        n, rows, total = self.spark.read.parquet(f"{at}/docs").agg(F.countDistinct("doc"), F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return name, n, rows, total

    def _write(self, blocks: DataFrame, docs: DataFrame, at: str) -> None:
        docs.write.option("compression", "zstd").parquet(f"{at}/docs")
        blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"), F.min("least").alias("least")).write.option("compression", "zstd").parquet(f"{at}/lexicon")

    def _block_schema(self) -> str:
        return f"term string, shard long, n int, most int, least int, postings array<struct<doc:{self.doc_type},at:int,tf:int,length:int>>"

    def _commit(self, segment: dict, ids: DataFrame | None = None) -> SegmentIndex:
        """Commit a segment; the tombstones of what it replaces are worked out against the version that it builds on."""
        at = f"{self.path}/{segment['name']}"

        def change(version: int, manifest: dict) -> dict:
            self.version, self.manifest = version, manifest
            made, old = dict(segment), self.docs() if manifest.get("segments") else None
            if old is not None:
                named = ids if ids is not None else self.spark.read.schema(f"doc {self.doc_type}").parquet(f"{at}/docs")
                gone = old.join(named.select("doc").distinct(), "doc", "left_semi")
                n, total = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
                if n:
                    dead = f"dead-{uuid.uuid4().hex}"
                    gone.select("doc").write.parquet(f"{self.path}/{dead}/dead")
                    held = self._blocks().join(gone.select("seg", "shard").distinct(), ["seg", "shard"]).select("seg", "term", F.explode("postings").alias("p"))
                    lost = held.select("seg", "term", "p.doc").join(gone.select("seg", "doc"), ["seg", "doc"], "left_semi").groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
                    lost.select("term", "df", F.lit(None).cast("int").alias("most"), F.lit(None).cast("int").alias("least")).write.option("compression", "zstd").parquet(f"{self.path}/{dead}/lexicon")
                    tomb = {"name": dead, "kinds": ["dead", "lexicon"], "n": -n, "total": -total, "seq": version + 1}
                    return {"segments": [*manifest["segments"], tomb, *([made | {"seq": version + 1}] if made["kinds"] else [])]}
            return {"segments": [*manifest.get("segments", []), *([made | {"seq": version + 1}] if made["kinds"] else [])]}

        self.log.commit(change)
        return self.refresh()

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> SegmentIndex:
        """Hide documents and take them out of all counts."""
        return self._commit({"name": f"none-{uuid.uuid4().hex}", "kinds": [], "n": 0, "total": 0}, ids.select(F.col(doc_id).cast(self.doc_type).alias("doc")).where("doc IS NOT NULL"))

    def compact(self) -> SegmentIndex:
        """The live documents as one segment; older segments stay for readers of older versions."""

        def change(version: int, manifest: dict) -> dict:
            self.version, self.manifest = version, manifest
            name = f"seg-{uuid.uuid4().hex}"
            at = f"{self.path}/{name}"
            n, total = self._size()
            parts = max(1, -(-n // (SHARD_DOCS * SHARDS_TOGETHER)))
            docs = self.docs().select("doc", "length", "seg", F.pmod(F.xxhash64("doc"), F.lit(parts)).alias("part"))
            place = F.row_number().over(Window.partitionBy("part").orderBy("doc")) - 1
            docs = docs.withColumn("place", place).select("doc", "length", "seg", (F.col("part") * (1 << 32) + F.floor(F.col("place") / SHARD_DOCS)).alias("shard"), (F.col("place") % SHARD_DOCS).alias("at"))
            docs = staged(docs, "docs")
            postings = self._blocks().select("seg", "term", F.explode("postings").alias("p")).select("seg", "term", "p.doc", "p.tf").join(docs, ["seg", "doc"])
            blocks = postings.groupBy("term", "shard").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"), F.collect_list(F.struct("doc", "at", "tf", "length")).alias("postings"))
            blocks.repartitionByRange("term", "shard").sortWithinPartitions("term", "shard").write.option("compression", "zstd").parquet(f"{at}/raw")
            self._write(self.spark.read.schema(self._block_schema()).parquet(f"{at}/raw"), docs.select("doc", "length", "shard"), at)
            return {"segments": [{"name": name, "kinds": ["docs", "raw", "lexicon"], "n": n, "total": total, "seq": version + 1}]}

        self.log.commit(change)
        return self.refresh()

    def _size(self) -> tuple[int, int]:
        return sum(s["n"] for s in self._segments()), sum(s["total"] for s in self._segments())

    def lexicon(self) -> DataFrame:
        """(term, df, most, least, idf) of the terms of live documents; idf before the floor of negative ones.

        `most` and `least` bound a term's frequency and the length of its documents; deletes leave them as they are.
        """
        n, _ = self._size()
        terms = self._union("lexicon", "term string, df long, most int, least int").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.min("least").alias("least")).where("df > 0")
        return terms.withColumn("idf", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))

    def _mean_idf(self) -> float:
        """Mean idf over the terms of this version, worked out by its first reader and kept beside the log."""
        facts = CommitLog(self.spark, f"{self.path}/means")
        if self.version not in facts.versions():
            facts.create(self.version, {"mean": self.lexicon().agg(F.avg("idf")).first()[0]})
        return facts.read(self.version)["mean"] or 0.0

    def search(self, queries: DataFrame, k: int, query_id: str = "item_id", text_col: str = "text", doc_id: str = "doc_id", report: dict | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank): the exact BM25 top k of each query, ties by id.

        Documents without a query token score 0: above negative scores, below positive ones. `report` receives how many
        (query, shard) blocks there were and how many were opened.
        """
        n, total = self._size()
        kind = queries.schema[query_id].dataType.simpleString()
        if k <= 0 or n <= 0:
            return self.spark.createDataFrame([], f"`{query_id}` {kind}, `{doc_id}` {self.doc_type}, score double, rank int")
        mean_length, floor = max(total / n, 1e-9), EPSILON * self._mean_idf()
        named = queries.select(F.col(query_id).alias("query"), F.col(text_col).alias("text"))
        counts = named.select("query", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
        w = F.col("qtf") * F.when(F.col("idf") < 0, F.lit(floor)).otherwise(F.col("idf"))
        terms = counts.join(self.lexicon(), "term").select("query", "term", "df", w.alias("w"), (w * _weight(F.col("most"), F.col("least"), mean_length)).alias("bound"))
        # terms of negative weight and the rarest ones come first, until their postings are several times k
        rarest = Window.partitionBy("query").orderBy(F.col("w") >= 0, "df", "term").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("df").over(rarest), F.lit(0))
        asked = staged(terms.withColumn("early", (F.col("w") < 0) | (before == 0) | (before + F.col("df") <= 16 * k + 256)), "asked")
        parts = max(1, -(-asked.select("query").distinct().count() // QUERY_BLOCK))
        found = None
        for i in range(parts):
            some = self._found(asked.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == i), k, mean_length, report)
            found = some if found is None else found.unionByName(some)
        best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
        scored = staged(found.withColumn("r", F.row_number().over(best)).where((F.col("r") <= k) | (F.col("score") < 0)).drop("r"), "scored")
        listed = scored.unionByName(self._unmatched(named.select("query").distinct(), scored, k))
        ranked = staged(listed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked")
        dropped(asked, scored)
        return ranked.select(F.col("query").alias(query_id), F.col("doc").alias(doc_id), "score", "rank")

    def _found(self, asked: DataFrame, k: int, mean_length: float, report: dict | None) -> DataFrame:
        """(query, doc, score) of a block of queries: at least the k best of each that score above 0, and all below 0 where those are fewer."""
        kind = asked.schema["query"].dataType.simpleString()
        part = asked.where("query IS NOT NULL").orderBy("term", "query").toArrow()  # the terms of at most about QUERY_BLOCK queries
        names, words = (part.column(c).combine_chunks().dictionary_encode() for c in ("query", "term"))
        query, word = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (names, words))
        df, w, bound, early = (part.column(c).to_numpy() for c in ("df", "w", "bound", "early"))
        blocks, least = self._blocks(), np.full(len(names.dictionary), -np.inf)

        def scored(which: np.ndarray, met: DataFrame) -> DataFrame:
            asks = _Asked(names.dictionary, query[which], np.searchsorted(word[which], np.arange(len(words.dictionary) + 1)), w[which], least)
            return self._scored(met, asks, k, mean_length, kind)

        def of(chosen: np.ndarray) -> DataFrame:
            """Blocks of the chosen words, with the number of the word."""
            listed = words.dictionary.take(pa.array(chosen)).to_pylist()
            numbers = self.spark.createDataFrame([(t, int(i)) for t, i in zip(listed, chosen, strict=True)], "term string, word int")
            named = blocks.where(F.col("term").isin(listed)) if len(listed) <= FEW_TERMS else blocks
            return named.join(F.broadcast(numbers), "term")

        if not early.all():
            # what the early terms alone bring is less than a whole score, as later terms have no negative weight: their k-th best is a threshold
            for name, at in _kth(scored(early, of(np.unique(word[early]))), k).collect():  # one row a query
                least[names.dictionary.index(pa.scalar(name, names.dictionary.type)).as_py()] = at
        # later terms that sum to less than the threshold bring in no document by themselves; those with most postings for their bound go first
        order = np.lexsort((word, bound / df, query, early))
        sums = np.cumsum(np.where(early, 0.0, bound)[order])
        firsts = np.searchsorted(query[order][: (~early).sum()], query[order])
        weak = np.zeros(len(w), bool)
        weak[order] = ~early[order] & (sums - np.append(0.0, sums)[firsts] < least[query[order]] - SLACK)
        strong, every = np.unique(word[~weak]), np.arange(len(words.dictionary))
        only_weak = np.setdiff1d(every, strong)
        met = of(strong)
        if len(only_weak):
            open_ = of(strong).select("seg", "shard").distinct()
            met = met.unionByName(of(only_weak).join(open_, ["seg", "shard"], "left_semi"))
        if report is not None:
            pairs = lambda rows: rows.drop("postings").join(asked.select("query", "term"), "term").count()
            blocks_, skipped = pairs(of(every)), pairs(of(only_weak).join(open_, ["seg", "shard"], "left_anti")) if len(only_weak) else 0
            report |= {"blocks": report.get("blocks", 0) + blocks_, "skipped": report.get("skipped", 0) + skipped}
        return scored(np.ones(len(w), bool), met)

    def _scored(self, met: DataFrame, asks: _Asked, k: int, mean_length: float, kind: str) -> DataFrame:
        """(query, doc, score) of blocks (word, seg, shard, postings): they meet by shards, and a task keeps each query's k best above 0."""
        rows = met.select("word", "seg", "shard", *[F.col(f"postings.{c}").alias(c) for c in ("doc", "at", "tf", "length")]).withColumn("at", F.col("at").cast("array<tinyint>"))
        dead = self._tombstones()
        gone = F.array().cast(f"array<{self.doc_type}>")
        if dead is not None:
            past = self._union("docs", f"doc {self.doc_type}, length int, shard long").join(dead, "doc").where("until > seg")
            rows = rows.join(past.groupBy("seg", "shard").agg(F.collect_list("doc").alias("gone")), ["seg", "shard"], "left")  # at most SHARD_DOCS a row
            gone = F.coalesce("gone", gone)
        rows = rows.withColumn("gone", gone).repartition("seg", "shard").sortWithinPartitions("seg", "shard")
        sent = self.spark.sparkContext.broadcast(asks)
        return rows.mapInArrow(lambda batches: _best(batches, sent.value, k, mean_length), f"query {kind}, doc {self.doc_type}, score double")

    def _unmatched(self, queries: DataFrame, scored: DataFrame, k: int) -> DataFrame:
        """(query, doc, 0.0): for queries with fewer than k positive scores, the least ids that hold none of their tokens.

        A window of the least ids is tried first; queries that find too few outside of their matches go on with twice the window.
        """
        have = scored.groupBy("query").agg(F.count(F.when(F.col("score") > 0, 1)).alias("above"))
        short = staged(queries.join(have, "query", "left").select("query", (F.lit(k) - F.coalesce("above", F.lit(0))).alias("need")).where("need > 0"), "short")
        out = self.spark.createDataFrame([], scored.schema)
        if short.isEmpty():
            return out
        ids, width, n = self.docs().select("doc"), 2 * k + 64, self._size()[0]
        while True:
            window = ids.orderBy("doc").limit(width).agg(F.collect_list("doc").alias("docs"))  # one row
            free = short.crossJoin(F.broadcast(window)).select("query", "need", F.explode("docs").alias("doc")).join(scored.select("query", "doc"), ["query", "doc"], "left_anti")
            free = staged(free.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("doc"))).where("r <= need"), "free")
            found = free.groupBy("query").agg(F.count(F.lit(1)).alias("found"))
            short_again = short.join(found, "query", "left").where(F.coalesce("found", F.lit(0)) < F.col("need")).select("query", "need")
            if width >= n:
                return out.unionByName(free.select("query", "doc", F.lit(0.0).alias("score")))
            short_again = staged(short_again, "short")
            out = out.unionByName(free.join(short_again, "query", "left_anti").select("query", "doc", F.lit(0.0).alias("score")))
            if short_again.isEmpty():
                return out
            short, width = short_again, 2 * width


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """(query, least): the k-th best positive score of each query that has so many."""
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    return scored.where("score > 0").withColumn("r", r).where(F.col("r") <= k).where(F.col("r") == k).select("query", F.col("score").alias("least"))


@dataclass(frozen=True)
class _Asked:
    """A block of queries by words: word i is asked by `query[starts[i]:starts[i + 1]]` with weights `w`; `least` bounds each query's list from below."""

    names: pa.Array
    query: np.ndarray
    starts: np.ndarray
    w: np.ndarray
    least: np.ndarray


def _best(batches: Iterator[pa.RecordBatch], asks: _Asked, k: int, mean_length: float) -> Iterator[pa.RecordBatch]:
    """(query, doc, score) of a task's shards, which come one after another: the k best of each query above 0, and those below 0 while there are fewer."""
    n = len(asks.names)
    group = max(1, min(GROUP_SHARDS, SCORES // (SHARD_DOCS * max(1, n))))
    least, kept = asks.least.copy(), None

    def cut(found: pa.Table) -> pa.Table:
        """The k best above 0 of each query, and what is below 0 of queries without k."""
        found = found.take(pc.sort_indices(found, [("query", "ascending"), ("score", "descending"), ("doc", "ascending")]))
        query, score = found.column("query").to_numpy(), found.column("score").to_numpy()
        firsts = np.searchsorted(query, query)
        place = np.arange(len(query)) - firsts
        full = (place == k - 1) & (score > 0)
        least[query[full]] = np.maximum(least[query[full]], score[full])
        return found.filter(pa.array((place < k) | ((score < 0) & (least[query] <= 0))))

    for rows in _groups(batches, group):
        found = _group_scores(rows, asks, k, mean_length, least)
        kept = found if kept is None else pa.concat_tables([kept, found])
        if len(kept) > 4 * k * n + (1 << 16):
            kept = cut(kept)
    if kept is not None:
        kept = cut(kept)
        columns = [asks.names.take(kept.column("query").combine_chunks()), kept.column("doc").combine_chunks(), kept.column("score").combine_chunks()]
        yield from pa.Table.from_arrays(columns, ["query", "doc", "score"]).to_batches(max_chunksize=1 << 16)


def _groups(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of up to `shards` whole shards, and the number of each block's shard among them."""
    held, count = [], 0
    def split(whole: pa.Table, last: bool) -> tuple[list, pa.Table]:
        shard, seg = (whole.column(c).to_numpy() for c in ("shard", "seg"))
        number = np.cumsum(np.append(False, (np.diff(shard) != 0) | (np.diff(seg) != 0)))
        edges = np.searchsorted(number, np.arange(0, number[-1] + 1 + shards, shards))
        edges = edges if last else edges[:-1]  # the last group may go on
        pieces = [(whole.slice(a, b - a), number[a:b] - number[a]) for a, b in zip(edges, edges[1:], strict=False) if b > a]
        return pieces, whole.slice(edges[-1])

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
        if count >= 1 << 17:
            pieces, rest = split(pa.concat_tables(held), False)
            yield from pieces
            held, count = [rest], 0
    if held and sum(map(len, held)):
        yield from split(pa.concat_tables(held), True)[0]


def _group_scores(rows: tuple[pa.Table, np.ndarray], asks: _Asked, k: int, mean_length: float, least: np.ndarray) -> pa.Table:
    """(query, doc, score), by the queries' numbers, of the documents of a group of shards that reach the bounds."""
    table, shard = rows
    n, slots = len(asks.names), (int(shard[-1]) + 1) * SHARD_DOCS
    lists = table.column("doc").combine_chunks()
    docs, size = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    at, tf, length = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("at", "tf", "length"))
    slot = np.repeat(shard * SHARD_DOCS, size) + at
    word = np.repeat(table.column("word").to_numpy(), size)
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
    # words that many of the documents have go as a matrix product, the others posting by posting
    many = np.flatnonzero(np.bincount(word, minlength=len(asks.starts) - 1) * 16 >= slots)
    place = np.full(len(asks.starts) - 1, -1)
    place[many] = np.arange(len(many))
    dense = place[word] >= 0
    have, want = np.zeros((len(many), slots)), np.zeros((n, len(many)))
    have[place[word[dense]], slot[dense]] = gain[dense]
    for i, x in enumerate(many):
        want[asks.query[asks.starts[x] : asks.starts[x + 1]], i] = asks.w[asks.starts[x] : asks.starts[x + 1]]
    scores = want @ have
    slot_, word_, gain_ = slot[~dense], word[~dense], gain[~dense]
    times = (asks.starts[1:] - asks.starts[:-1])[word_]
    ends = np.cumsum(times)
    for a, b in _spans(ends, SCORES // 4):
        t = times[a:b]
        nth = np.arange(t.sum()) - np.repeat(ends[a:b] - t - (ends[a - 1] if a else 0), t) + np.repeat(asks.starts[word_[a:b]], t)
        scores += np.bincount(asks.query[nth] * slots + np.repeat(slot_[a:b], t), asks.w[nth] * np.repeat(gain_[a:b], t), n * slots).reshape(n, slots)
    scores = np.round(scores, PLACES)
    where = np.zeros(slots, np.int64)
    where[slot] = np.arange(len(slot))
    if len(table.column("gone").combine_chunks().flatten()):
        gone = table.column("gone").combine_chunks()
        row = np.unique(shard, return_index=True)[1]  # a shard's rows have the same list
        for i, r in enumerate(row):
            own = np.unique(slot[slot // SHARD_DOCS == i])
            scores[:, own[pc.is_in(docs.take(pa.array(where[own])), gone[r].values).to_numpy(zero_copy_only=False)]] = 0.0
    bound = least - SLACK
    if k < slots and np.count_nonzero(scores >= bound[:, None]) > 8 * k * n:
        ahead = np.partition(scores, slots - k, axis=1)[:, slots - k]  # the k-th best of the group
        bound = np.where(ahead > 0, np.maximum(bound, ahead), bound)
    query, found = np.nonzero((scores != 0) & (scores >= bound[:, None]))
    return pa.table({"query": query, "doc": docs.take(pa.array(where[found])), "score": scores[query, found]})


def _spans(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes sum to about `most`; `ends` is the running sum of the sizes."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (doc, tokens): each term's postings in a run of `SHARD_DOCS` documents, and a row without a term that lists the run's documents."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, SHARD_DOCS):
            docs, tokens = batch.column(0).slice(at, SHARD_DOCS), batch.column(1).slice(at, SHARD_DOCS)
            length = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            coded = tokens.flatten().dictionary_encode()
            owner = np.repeat(np.arange(len(docs)), length)
            key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * SHARD_DOCS + owner, return_counts=True)
            term, doc = key // SHARD_DOCS, key % SHARD_DOCS
            starts = np.flatnonzero(np.diff(term, prepend=-1)) if len(term) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(term))[: len(starts)]
            most = np.maximum.reduceat(tf, starts) if len(starts) else tf
            least = np.minimum.reduceat(length[doc], starts) if len(starts) else tf
            # the last list is the run's documents, under a null term
            doc, tf = np.concatenate([doc, np.arange(len(docs))]), np.concatenate([tf, np.zeros(len(docs), np.int64)])
            postings = pa.StructArray.from_arrays([docs.take(pa.array(doc)), pa.array(doc.astype(np.int32)), pa.array(tf.astype(np.int32)), pa.array(length[doc])], ["doc", "at", "tf", "length"])
            offsets = np.concatenate([starts, [len(key), len(doc)]]).astype(np.int32)
            terms = pa.concat_arrays([coded.dictionary.take(pa.array(term[starts])).cast(pa.string()), pa.nulls(1, pa.string())])
            ints = lambda x, last: pa.array(np.append(x, last).astype(np.int32))
            columns = [terms, pa.array(np.full(len(terms), shard)), ints(ends - starts, len(docs)), ints(most, 0), ints(least, 0), pa.ListArray.from_arrays(offsets, postings)]
            yield pa.RecordBatch.from_arrays(columns, ["term", "shard", "n", "most", "least", "postings"])
            shard += 1


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
