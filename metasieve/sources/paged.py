"""Bibliographic databases by their paged interfaces: id batches, cursor chains, and a data source over both.

Nothing here knows a network. A transport answers requests: for tables of requests a function from DataFrame to DataFrame,
for the data source a function that each task calls.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from metasieve.sources.bibliography import OPENALEX, PUBMED, openalex_studies, pubmed_studies

#: Ids of a fetch or works of a page; records of a query at most, by database: fixed values.
PAGE, MOST = 200, {"pubmed": 5000, "openalex": 2000}

#: Answers one request: (kind: esearch, efetch or works; its parameters) -> the body. Errors are raised.
Transport = Callable[[str, dict], str]


def id_batches(ids: DataFrame, size: int = PAGE, most: int = MOST["pubmed"]) -> DataFrame:
    """query, batch, ids: the first `most` ids (query, ord, pmid) of each query in order, `size` to a batch."""
    place = F.row_number().over(Window.partitionBy("query").orderBy("ord", "pmid"))
    rows = ids.withColumn("place", place).filter(F.col("place") <= most).withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int"))
    listed = rows.groupBy("query", "batch").agg(F.sort_array(F.collect_list(F.struct("place", "pmid"))).alias("p"))
    return listed.select("query", "batch", F.transform("p", lambda x: x["pmid"]).alias("ids"))


def fetch_details(batches: DataFrame, transport: Callable[[DataFrame], DataFrame], partial: bool = False) -> DataFrame:
    """query, batch and the study records that transport's answers (query, batch, body: an XML article set) hold.

    A query of which a batch has no body gives no records, as a search that fails midway; with partial, those it got.
    """
    bodies = batches.select("query", "batch").join(transport(batches), ["query", "batch"], "left")
    if not partial:
        bodies = bodies.join(bodies.filter("body IS NULL").select("query").distinct(), "query", "left_anti")
    sets = bodies.select("query", "batch", F.from_xml("body", f"PubmedArticle array<struct<{_fields(PUBMED)}>>").alias("s"))
    return pubmed_studies(sets.select("query", "batch", F.inline("s.PubmedArticle")))


def _fields(ddl: str) -> str:
    """Column definitions as fields of a struct type."""
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def cursor_pages(query: str, transport: Transport, most: int) -> Iterator[tuple[int, str]]:
    """(page, body) of a query's works, from cursor to cursor until one is missing, repeats, or `most` works are there."""
    cursor, page, got = "*", 0, 0
    while got < most:
        body = transport("works", {"search": query, "per_page": min(PAGE, most), "cursor": cursor})
        told = json.loads(body)
        works = told.get("results") or []
        if not works:
            return
        yield page, body
        got, page, then = got + len(works), page + 1, (told.get("meta") or {}).get("next_cursor")
        if not then or then == cursor:
            return
        cursor = then


def openalex_pages(queries: DataFrame, transport: Transport, most: int = MOST["openalex"]) -> DataFrame:
    """query, page, body: each query's cursor chain, followed by one task a query. A query that fails gives no page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for q in f["query"]:
                try:
                    pages = list(cursor_pages(q, transport, most))
                except (OSError, ValueError, KeyError):
                    continue
                yield pd.DataFrame([(q, *p) for p in pages], columns=["query", "page", "body"])

    return queries.select("query").distinct().mapInPandas(run, "query string, page int, body string")


def openalex_records(pages: DataFrame, most: int = MOST["openalex"]) -> DataFrame:
    """query, page and the study records of pages (query, page, body), the first `most` of each query."""
    works = pages.select("query", "page", F.from_json("body", f"results array<struct<{_fields(OPENALEX)}>>").alias("b"))
    rows = works.select("query", "page", F.posexplode("b.results").alias("pos", "w"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("page", "pos"))
    return openalex_studies(rows.withColumn("place", place).filter(F.col("place") <= most).select("query", "page", "w.*"))


@dataclass
class Batch(InputPartition):
    """One request of a query: some ids, or a whole cursor chain."""

    query: str
    number: int
    ids: tuple[str, ...] = ()


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.database, self.most = options["database"], int(options.get("most", MOST[options["database"]]))
        self.queries = json.loads(options["queries"])
        module, _, name = options["transport"].partition(":")
        self.place, self.options = (module, name), dict(options)

    def _transport(self) -> Transport:
        found = getattr(importlib.import_module(self.place[0]), self.place[1])
        return lambda kind, params: found(kind, params, self.options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Queries that a filter on `query` leaves out are never asked; other filters stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("query",):
                self.queries = [q for q in self.queries if q == f.value]
            elif isinstance(f, In) and f.attribute == ("query",):
                self.queries = [q for q in self.queries if q in f.value]
            else:
                yield f

    def partitions(self) -> list[Batch]:
        if self.database == "openalex":
            return [Batch(q, k) for k, q in enumerate(self.queries)]
        out, ask = [], self._transport()
        for q in self.queries:
            ids = json.loads(ask("esearch", {"term": q, "retmax": self.most})).get("esearchresult", {}).get("idlist", [])[: self.most]
            out += [Batch(q, at // PAGE, tuple(ids[at : at + PAGE])) for at in range(0, len(ids), PAGE)]
        return out

    def read(self, partition: Batch | None) -> Iterator[tuple]:
        if partition is None:  # no query is left
            return
        ask = self._transport()
        if self.database == "openalex":
            yield from ((partition.query, page, body) for page, body in cursor_pages(partition.query, ask, self.most))
        else:
            yield partition.query, partition.number, ask("efetch", {"id": ",".join(partition.ids)})


class PagedBibliography(DataSource):
    """spark.read.format("paged_bibliography"): query, batch, body of the answers of a database.

    Options: database (pubmed, openalex), queries (a JSON list), transport (module:function, called by driver and tasks with
    kind, parameters and the options), most. A PubMed query is searched once by the driver, its ids are dealt in batches, a
    task each; an OpenAlex query is a chain of cursors, a task each.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_bibliography"

    def schema(self) -> str:
        return "query string, batch int, body string"

    def reader(self, schema) -> PagedReader:  # noqa: ARG002
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the data source known to a session, with filters pushed down to it."""
    spark.dataSource.register(PagedBibliography)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_paged(spark: SparkSession, database: str, queries: list[str], transport: str, **options: str) -> DataFrame:
    """query, batch or page, and the study records of queries to a database."""
    register(spark)
    reader = spark.read.format("paged_bibliography").options(database=database, queries=json.dumps(queries), transport=transport, **options)
    pages = reader.load()
    if database == "openalex":
        return openalex_records(pages.withColumnRenamed("batch", "page"), int(options.get("most", MOST["openalex"])))
    return fetch_details(pages.select("query", "batch"), lambda _: pages)
