"""Providers of disclosures as a Spark data source: a partition a page, filters pushed to the provider, a stream over new pages.

A provider is any object with `pages(wanted)` and `fetch(page)`. `wanted` holds what the query fixes of company, kind and
earliest date; pages are small tuples, and `fetch` gives the page's rows. `load("module:name", ...)` names providers where workers can
import them. A page that fails gives one row with its error instead of ending the query; `found` keeps the rows and raises
where there are none, `failed` lists the errors.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, SimpleDataSourceStreamReader

from factloom.functions.text import strip
from factloom.sources.scans import local_documents, parsed_documents

NAME = "disclosures"
SCHEMA = "provider string, company string, kind string, title string, url string, published date, content string, error string"
FIELDS = ("company", "kind", "title", "url", "published", "content")
FILTERS = "spark.sql.python.filterPushdown.enabled"


def load(name: str) -> Any:
    """The provider that "module:attribute" makes when called."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


@dataclass
class Page(InputPartition):
    """One page of one provider."""

    provider: str
    page: tuple


def _rows(provider: str, page: tuple) -> Iterator[tuple]:
    try:
        rows = [tuple(r.get(f) for f in FIELDS) for r in load(provider).fetch(page)]
    except Exception as e:  # noqa: BLE001  # whatever a provider raises is its row in the error table
        yield (provider, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])
        return
    for r in rows:
        yield (provider, *r, None)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.providers = [p for p in options.get("providers", "").split(",") if p]
        self.wanted: dict[str, object] = {}

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Takes equality of company and kind and the earliest date; Spark still checks every filter, so a page may hold more."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("company",), ("kind",)) or isinstance(f, GreaterThanOrEqual) and f.attribute == ("published",):
                self.wanted[f.attribute[0]] = f.value
            yield f

    def partitions(self) -> list[Page]:
        out = []
        for name in self.providers:
            try:
                out += [Page(name, tuple(p)) for p in load(name).pages(dict(self.wanted))]
            except Exception:  # noqa: BLE001  # a provider that can't list its pages fails as its one page
                out.append(Page(name, ()))
        return out or [Page("", ())]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _rows(partition.provider, partition.page) if partition.provider else iter(())


class _Stream(SimpleDataSourceStreamReader):
    """Offsets are how many pages of each provider have been read; a provider only ever appends pages."""

    def __init__(self, options: dict[str, str]) -> None:
        self.providers = [p for p in options.get("providers", "").split(",") if p]
        self.most = int(options.get("pagespertrigger", "1000"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {p: 0 for p in self.providers}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {p: min(len(list(load(p).pages({}))), start.get(p, 0) + self.most) for p in self.providers}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([row for p in self.providers for page in list(load(p).pages({}))[start.get(p, 0) : end[p]] for row in _rows(p, tuple(page))])


class Disclosures(DataSource):
    """format("disclosures"), option `providers`: names, separated by commas."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set(FILTERS, "true")
    spark.dataSource.register(Disclosures)
    return spark


def disclosures(spark: SparkSession, providers: list[str]) -> DataFrame:
    return register(spark).read.format(NAME).option("providers", ",".join(providers)).load()


def failed(rows: DataFrame) -> DataFrame:
    """(provider, error, pages) of the pages that failed."""
    return rows.where("error IS NOT NULL").groupBy("provider", "error").agg(F.count(F.lit(1)).alias("pages"))


def found(rows: DataFrame) -> DataFrame:
    """Rows without the errors; a ValueError where no provider gave any."""
    good = rows.where("error IS NULL").drop("error")
    if good.isEmpty():
        raise ValueError(f"no provider gave a row: {json.dumps([[r['provider'], r['error']] for r in failed(rows).limit(20).collect()])}")
    return good


def company_documents(spark: SparkSession, root: str, company: str) -> DataFrame:
    """Parsed local documents of a company: those in its folder or its slug's, else those right under `root`; none is a ValueError.

    Blank bodies are left out; a document without a title has its file's name. Folders are looked up in the store that `root` names.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    exists = lambda p: (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at)
    folders = [f for f in dict.fromkeys(f"{root.rstrip('/')}/{n}" for n in (company, company.strip().lower().replace(" ", "_"))) if _below(f) and exists(f)]
    files = None
    for folder in folders:
        part = local_documents(spark, folder, "*.{txt,md,TXT,MD}")
        files = part if files is None else files.unionByName(part)
    if files is None or files.isEmpty():
        if not exists(root):
            raise ValueError(f"no documents of {company!r} under {root}")
        at = jvm.org.apache.hadoop.fs.Path(root)
        under = [s.getPath().toString() for s in at.getFileSystem(conf).listStatus(at) if s.isFile() and s.getPath().getName().lower().endswith((".txt", ".md"))]
        if not under:
            raise ValueError(f"no documents of {company!r} under {root}")
        text = spark.read.format("text").option("wholetext", True).load(under)
        files = text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    stem = F.regexp_replace(F.regexp_extract(F.url_decode("path"), r"([^/]+)\.[^./]+$", 1), "_", " ")
    rows = parsed_documents(files.dropDuplicates(["path"])).where(strip(F.col("raw_content")) != "").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), stem))
    if rows.isEmpty():
        raise ValueError(f"no documents of {company!r} under {root}")
    return rows


def _below(folder: str) -> bool:
    """A folder below its root: a blank company names the root itself."""
    return bool(folder.rsplit("/", 1)[1].strip())
