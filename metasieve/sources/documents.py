"""Full texts: download candidates, file checks, page text, and the sinks of a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sources of a full text in the order in which they are tried, and the identifier that each needs: fixed values.
CASCADE = (("unpaywall", "doi"), ("pmc", "pmcid"), ("europepmc", "pmid"), ("semantic_scholar", "doi"), ("doi_redirect", "doi"))
#: Addresses that follow from an identifier alone, and those that a lookup is asked at: fixed values.
PMC_URL, DOI_URL = "https://www.ncbi.nlm.nih.gov/pmc/articles/%s/pdf/", "https://doi.org/%s"
LOOKUP_URLS = {"unpaywall": "https://api.unpaywall.org/v2/%s", "europepmc": "https://www.ebi.ac.uk/europepmc/webservices/rest/search?query=ext_id:%s&format=json", "semantic_scholar": "https://api.semanticscholar.org/graph/v1/paper/DOI:%s?fields=openAccessPdf"}
LEAST_BYTES = 1000


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def candidates(studies: DataFrame) -> DataFrame:
    """study_id, source, priority, asks, url of the sources that a study's identifiers (doi, pmid, pmcid) allow.

    url is known where an identifier makes it; else asks is the address whose answer (see found_url) tells it.
    """
    def option(k: int, source: str, needs: str) -> Column:
        c = F.col(needs)
        asks = F.format_string(LOOKUP_URLS[source], c) if source in LOOKUP_URLS else F.lit(None).cast("string")
        url = F.format_string(PMC_URL if source == "pmc" else DOI_URL, c) if source not in LOOKUP_URLS else F.lit(None).cast("string")
        return F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.lit(source).alias("source"), F.lit(k).alias("priority"), asks.alias("asks"), url.alias("url")))

    return studies.select("study_id", F.inline(F.array_compact(F.array(*(option(k, *x) for k, x in enumerate(CASCADE))))))


def found_url(source: Column, body: Column) -> Column:
    """The address of a file in a lookup's answer (JSON); null for an answer that is none or names none."""
    place = "struct<url_for_pdf:string,url:string>"
    either = lambda x: F.coalesce(_given(x["url_for_pdf"]), _given(x["url"]))
    u = F.from_json(body, f"best_oa_location {place}, oa_locations array<{place}>")
    best = u["best_oa_location"]
    named = F.coalesce(F.get_json_object(body, "$.best_oa_location"), F.lit("{}")) != "{}"  # one without an address still counts
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), F.lit(0))
    unpaywall = F.when(named, either(best)).otherwise(first(F.transform(u["oa_locations"], either)))
    e = F.from_json(body, "resultList struct<result:array<struct<pmcid:string>>>")["resultList"]["result"]
    europepmc = F.format_string(PMC_URL, first(F.transform(e, lambda x: _given(x["pmcid"]))))
    europepmc = F.when(first(F.transform(e, lambda x: _given(x["pmcid"]))).isNotNull(), europepmc)
    scholar = _given(F.from_json(body, "openAccessPdf struct<url:string>")["openAccessPdf"]["url"])
    return F.when(source == "unpaywall", unpaywall).when(source == "europepmc", europepmc).when(source == "semantic_scholar", scholar)


def candidate_urls(studies: DataFrame, answers: DataFrame) -> DataFrame:
    """study_id, source, priority, url to be fetched: from identifiers, or from the answers (asks, body) of lookups.

    Sources whose lookup has no answer, or one without an address, are left out.
    """
    asked = candidates(studies).join(answers.select("asks", "body"), "asks", "left")
    url = F.coalesce("url", found_url(F.col("source"), F.col("body")))
    return asked.select("study_id", "source", "priority", url.alias("url")).filter("url IS NOT NULL")


def open_access_key(doi: Column, pmid: Column) -> Column:
    """What a work's open access is looked up by: the doi, else the pmid, else null."""
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("doi:"), doi)).when(F.coalesce(pmid, F.lit("")) != "", F.concat(F.lit("pmid:"), pmid))


def open_access_url(status: Column, body: Column) -> Column:
    """The address of a work's file: its open access one, else the best location's file or page; null where none is told."""
    w = F.from_json(body, "open_access struct<is_oa:boolean,oa_url:string>, best_oa_location struct<pdf_url:string,landing_page_url:string>")
    own = F.when(w["open_access"]["is_oa"], _given(w["open_access"]["oa_url"]))
    return F.when(status == 200, F.coalesce(own, _given(w["best_oa_location"]["pdf_url"]), _given(w["best_oa_location"]["landing_page_url"])))


def is_valid_file(status: Column, length: Column, content_type: Column, head: Column) -> Column:
    """An answer holds a file: status 200, over LEAST_BYTES, and either its type or its first five characters say PDF."""
    pdf = F.contains(F.coalesce(content_type, F.lit("")), F.lit("pdf")) | (F.coalesce(head, F.lit("")) == "%PDF-")
    return F.coalesce((status == 200) & (length > LEAST_BYTES) & pdf, F.lit(False))


def downloaded(urls: DataFrame, fetched: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """study_id, outcome of every study of urls: cached, the first source in order that gave a valid file, or failed.

    urls is candidate_urls(); fetched has study_id, source, status, length, content_type, head of the answers so far; cached
    has study_id, length of files at hand, of which those over LEAST_BYTES count.
    """
    ok = is_valid_file(F.col("status"), F.col("length"), F.col("content_type"), F.col("head"))
    tried = urls.join(fetched.filter(ok).select("study_id", "source", F.lit(True).alias("ok")), ["study_id", "source"], "left")
    best = tried.groupBy("study_id").agg(F.min_by("source", F.when(F.col("ok"), F.col("priority"))).alias("source"), F.max("ok").alias("ok"))
    outcome = F.when(F.col("ok"), F.col("source")).otherwise("failed")
    if cached is None:
        return best.select("study_id", outcome.alias("outcome"))
    have = cached.filter(F.col("length") > LEAST_BYTES).select("study_id", F.lit(True).alias("have")).distinct()
    return best.join(have, "study_id", "left").select("study_id", F.when(F.col("have"), "cached").otherwise(outcome).alias("outcome"))


def first_success(candidate: DataFrame, fetched: DataFrame) -> DataFrame:
    """study_id, source: the first source, in order, whose file (study_id, source, ok) is valid."""
    return candidate.join(fetched.filter("ok"), ["study_id", "source"]).groupBy("study_id").agg(F.min_by("source", "priority").alias("source"))


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, length, content, ok: files large enough that start as a PDF does."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", "content", ((F.col("length") > LEAST_BYTES) & (F.decode(F.substring("content", 1, 5), "ISO-8859-1") == "%PDF-")).alias("ok"))


def extract_pages(files: DataFrame, extractor: Callable[[bytes, int], list[str]], max_pages: int = 50) -> DataFrame:
    """path, text: the pages that extractor gives for a file's bytes, each after its mark. A file that fails has no text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for content in f["content"]:
                try:
                    pages = extractor(bytes(content), max_pages)[:max_pages]
                    out.append("\n\n".join(f"<!-- PAGE {k} -->\n{p}" for k, p in enumerate(pages, 1)))
                except (ValueError, KeyError, OSError):
                    out.append(None)
            yield pd.DataFrame({"path": f["path"], "text": out})

    return files.filter("ok").select("path", "content").mapInPandas(run, "path string, text string")


def write_run(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a run as JSON lines below path."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A project file, which may span lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)
