"""Study records from bibliographic files: PubMed XML and OpenAlex JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasieve.functions.text import abstract_from_index

STUDY = ("study_id", "pmid", "title", "abstract", "authors", "year", "doi", "journal", "source")
AUTHORS = 10

_TEXT = "struct<_VALUE:string,_Label:string>"
PUBMED = (
    "MedlineCitation struct<PMID:struct<_VALUE:string,_Version:string>,Article:struct<ArticleTitle:string,"
    f"Abstract:struct<AbstractText:array<{_TEXT}>>,AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>,"
    "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,"
    "ELocationID:array<struct<_VALUE:string,_EIdType:string>>>>"
)
OPENALEX = (
    "id string, doi string, title string, publication_year long, cited_by_count long, "
    "authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, "
    "open_access struct<is_oa:boolean,oa_url:string>, ids struct<pmid:string,pmcid:string>, abstract_inverted_index map<string,array<int>>"
)


def _or_empty(c) -> F.Column:
    return F.coalesce(c, F.lit(""))


def read_pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Study records of PubmedArticle elements; articles without a citation or article are left out.

    The abstract joins its parts with their labels, authors are "Last, First", the year is the stated one or the first
    four digits of the date's text, the doi is the last one given.
    """
    return pubmed_studies(spark.read.schema(PUBMED).option("rowTag", "PubmedArticle").format("xml").load(path))


def pubmed_studies(m: DataFrame) -> DataFrame:
    """Study records of rows that have the fields of PUBMED; see read_pubmed. Columns named query or batch stay in front."""
    a = F.col("MedlineCitation.Article")
    part = F.transform(a["Abstract"]["AbstractText"], lambda t: F.when(_or_empty(t["_Label"]) != "", F.concat(t["_Label"], F.lit(": "), _or_empty(t["_VALUE"]))).otherwise(_or_empty(t["_VALUE"])))
    named = F.filter(a["AuthorList"]["Author"], lambda x: _or_empty(x["LastName"]) != "")
    author = F.transform(named, lambda x: F.when(_or_empty(x["ForeName"]) != "", F.concat(x["LastName"], F.lit(", "), x["ForeName"])).otherwise(x["LastName"]))
    date = a["Journal"]["JournalIssue"]["PubDate"]
    dois = F.filter(a["ELocationID"], lambda e: e["_EIdType"] == "doi")
    pmid = _or_empty(F.col("MedlineCitation.PMID._VALUE"))
    return m.filter(a.isNotNull()).select(
        *(c for c in ("query", "batch") if c in m.columns), F.concat(F.lit("PMID_"), pmid).alias("study_id"), pmid.alias("pmid"), _or_empty(a["ArticleTitle"]).alias("title"), _or_empty(F.array_join(part, " ")).alias("abstract"),
        F.coalesce(author, F.array().cast("array<string>")).alias("authors"), F.coalesce(F.nullif(date["Year"], F.lit("")), F.regexp_extract(date["MedlineDate"], r"(\d{4})", 1), F.lit("")).alias("year"),
        _or_empty(F.get(F.reverse(dois), F.lit(0))["_VALUE"]).alias("doi"), _or_empty(a["Journal"]["Title"]).alias("journal"), F.lit("pubmed").alias("source"),
    )


def read_openalex(spark: SparkSession, path: str) -> DataFrame:
    """Study records of works, one JSON object a line, with pmcid, cited_by_count, is_oa and oa_url."""
    return openalex_studies(spark.read.schema(OPENALEX).json(path))


def openalex_studies(w: DataFrame) -> DataFrame:
    """Study records of rows that have the fields of OPENALEX; see read_openalex. Columns named query or page stay in front."""
    names = F.filter(F.transform(F.slice("authorships", 1, AUTHORS), lambda x: x["author"]["display_name"]), lambda x: _or_empty(x) != "")
    return w.select(
        *(c for c in ("query", "page") if c in w.columns), F.concat(F.lit("OA_"), F.element_at(F.split(_or_empty(F.col("id")), "/"), -1)).alias("study_id"), F.replace(_or_empty(F.col("ids.pmid")), F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.lit("")).alias("pmid"),
        _or_empty(F.col("title")).alias("title"), abstract_from_index(F.col("abstract_inverted_index")).alias("abstract"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        _or_empty(F.col("publication_year").cast("string")).alias("year"), F.replace(_or_empty(F.col("doi")), F.lit("https://doi.org/"), F.lit("")).alias("doi"), _or_empty(F.col("primary_location.source.display_name")).alias("journal"),
        F.lit("openalex").alias("source"), _or_empty(F.col("ids.pmcid")).alias("pmcid"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), F.coalesce("open_access.is_oa", F.lit(False)).alias("is_oa"), _or_empty(F.col("open_access.oa_url")).alias("oa_url"),
    )


def search(databases: list[tuple[str, DataFrame]], preloaded: DataFrame | None = None) -> DataFrame:
    """The records of all known databases in query order (query_ord), or the preloaded studies; other names are skipped."""
    if preloaded is not None:
        return preloaded
    known = [df.withColumn("query_ord", F.lit(k)) for k, (name, df) in enumerate(databases) if any(x in name.lower() for x in ("pubmed", "openalex"))]
    if not known:
        raise ValueError("no known database")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), known)
