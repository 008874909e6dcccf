"""Paged databases, addresses of full texts, and the download cascade in batch and as a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from metasieve.sources import documents, paged
from metasieve.streaming.downloads import cascade_step, download_steps


@pytest.fixture
def store(tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "store.json").write_text(json.dumps({"found": {"one": [str(k) for k in range(450)], "two": ["7"]}, "works": {"w": list(range(430)), "none": [], "edge": list(range(200))}}))
    return {"store": str(tmp_path / "store.json"), "log": str(tmp_path / "log")}


def requests(store, tmp_path):
    return [json.loads(p.read_text()) for p in (tmp_path / "log").iterdir()]


def test_pubmed_source_deals_ids_in_batches_of_200(spark, store, tmp_path):
    paged.register(spark)
    pages = spark.read.format("paged_bibliography").options(database="pubmed", queries='["one", "two", "three"]', transport="tests.paged_transport:answer", **store).load()
    assert pages.rdd.getNumPartitions() == 4  # 200 + 200 + 50 ids, and one
    got = paged.read_paged(spark, "pubmed", ["one", "two", "three"], "tests.paged_transport:answer", **store)
    assert sorted((r.query, r.batch, r.study_id, r.title) for r in got.collect()) == sorted([("one", k // 200, f"PMID_{k}", f"T{k}") for k in range(450)] + [("two", 0, "PMID_7", "T7")])


def test_a_filter_on_the_query_spares_requests_and_most_bounds_them(spark, store, tmp_path):
    got = paged.read_paged(spark, "pubmed", ["one", "two"], "tests.paged_transport:answer", most="220", **store).filter("query = 'two'")
    assert [r.study_id for r in got.collect()] == ["PMID_7"]
    fetched = [p["id"] for kind, p in requests(store, tmp_path) if kind == "efetch"]
    assert set(fetched) == {"7"}


def test_openalex_source_follows_cursors(spark, store, tmp_path):
    got = paged.read_paged(spark, "openalex", ["w", "none", "edge"], "tests.paged_transport:answer", **store)
    rows = got.collect()
    assert sorted((r.query, r.page, r.study_id) for r in rows) == sorted([("w", k // 200, f"OA_W{k}") for k in range(430)] + [("edge", 0, f"OA_W{k}") for k in range(200)])
    assert rows[0].abstract == "a b" and rows[0].doi == "10.1/x"
    capped = paged.read_paged(spark, "openalex", ["w"], "tests.paged_transport:answer", most="210", **store)
    assert capped.count() == 210


def test_tables_of_requests(spark):
    ids = spark.createDataFrame([("q", k, str(100 - k)) for k in range(7)] + [("r", 0, "1")], "query string, ord long, pmid string")
    batches = paged.id_batches(ids, size=3, most=5)
    assert sorted(tuple(r) for r in batches.collect()) == [("q", 0, ["100", "99", "98"]), ("q", 1, ["97", "96"]), ("r", 0, ["1"])]
    body = F.concat(F.lit("<S>"), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), i, F.lit("</PMID><Article><ArticleTitle>t</ArticleTitle></Article></MedlineCitation></PubmedArticle>"))), ""), F.lit("</S>"))
    failing = lambda b: b.filter("NOT (query = 'q' AND batch = 1)").select("query", "batch", body.alias("body"))
    assert [r.study_id for r in paged.fetch_details(batches, failing).collect()] == ["PMID_1"]
    assert sorted(r.study_id for r in paged.fetch_details(batches, failing, partial=True).collect()) == ["PMID_1", "PMID_100", "PMID_98", "PMID_99"]

    def broken(kind, params):
        if params["search"] == "bad":
            raise OSError("no answer")
        return json.dumps({"results": [{"id": "https://openalex.org/W1", "title": "t"}], "meta": {"next_cursor": "*"}})

    pages = paged.openalex_pages(spark.createDataFrame([("good",), ("bad",)], "query string"), broken)
    assert [(r.query, r.study_id) for r in paged.openalex_records(pages).collect()] == [("good", "OA_W1")]


def test_addresses(spark):
    def url(source, body):
        return spark.range(1).select(documents.found_url(F.lit(source), F.lit(body)).alias("x")).first().x

    assert url("unpaywall", '{"best_oa_location": {"url": "a"}}') == "a"
    assert url("unpaywall", '{"best_oa_location": {"license": "x"}, "oa_locations": [{"url": "b"}]}') is None
    assert url("unpaywall", '{"best_oa_location": {}, "oa_locations": [{"url": null}, {"url_for_pdf": "b"}]}') == "b"
    assert url("europepmc", '{"resultList": {"result": [{"pmcid": "PMC1"}]}}').endswith("/PMC1/pdf/") and url("europepmc", "[]") is None
    assert url("semantic_scholar", '{"openAccessPdf": {"url": "c"}}') == "c" and url("semantic_scholar", None) is None and url("pmc", "{}") is None
    work = lambda status, body: spark.range(1).select(documents.open_access_url(F.lit(status), F.lit(body)).alias("x")).first().x
    assert work(200, '{"open_access": {"is_oa": true, "oa_url": "a"}}') == "a" and work(404, '{"open_access": {"is_oa": true, "oa_url": "a"}}') is None
    assert work(200, '{"open_access": {"is_oa": false, "oa_url": "a"}, "best_oa_location": {"landing_page_url": "b"}}') == "b"
    keys = spark.createDataFrame([("d", "p"), ("", "p"), (None, None)], "d string, p string").select(documents.open_access_key(F.col("d"), F.col("p")).alias("k")).collect()
    assert [r.k for r in keys] == ["doi:d", "pmid:p", None]
    valid = spark.createDataFrame([(200, 1001, "application/pdf", None), (200, 1001, "text/html", "%PDF-"), (200, 1000, "x/pdf", "%PDF-"), (404, 9999, "x/pdf", None), (200, 1001, None, None)], "s int, n long, c string, h string")
    assert [r.ok for r in valid.select(documents.is_valid_file(F.col("s"), F.col("n"), F.col("c"), F.col("h")).alias("ok")).collect()] == [True, True, False, False, False]


def test_cascade_step():
    assert cascade_step(["a", "b"], [0, 2]) == ("next", "a") and cascade_step(["a", "b"], [1, 2]) == ("done", "b") and cascade_step(["a"], [1]) == ("failed", None) and cascade_step([], []) == ("failed", None)


def test_stream_ends_as_the_batch_does_over_a_restart(spark, tmp_path):
    rng = random.Random(3)
    kind = "study_id string, kind string, sources array<string>, source string, status int, length long, content_type string, head string"
    order, events, urls, answers, cached = ["unpaywall", "pmc", "europepmc", "doi_redirect"], [], [], [], []
    for k in range(40):
        sid, sources = f"s{k}", order[: rng.randrange(1, 5)]
        events.append((sid, "offer", sources, None, None, None, None, None))
        urls += [(sid, s, p, "u") for p, s in enumerate(sources)]
        if rng.random() < 0.2:
            cached.append((sid, rng.choice([900, 1001])))
            events.append((sid, "cache", None, None, None, cached[-1][1], None, None))
        for s in sources:
            a = (sid, s, rng.choice([200, 200, 404]), rng.choice([10, 5000]), rng.choice(["application/pdf", "text/html"]), rng.choice([None, "%PDF-"]))
            answers.append(a)
            events += [(sid, "answer", None, *a[1:])] * rng.choice([1, 2])
    rng.shuffle(events)
    want = {r.study_id: r.outcome for r in documents.downloaded(spark.createDataFrame(urls, "study_id string, source string, priority int, url string"), spark.createDataFrame(answers, "study_id string, source string, status int, length long, content_type string, head string"), spark.createDataFrame(cached, "study_id string, length long")).collect()}
    told = {}

    def run():
        stream = download_steps(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))

        def keep(df, _):
            for r in df.collect():
                told.setdefault(r.study_id, []).append(r.source if r.step == "done" else r.step)

        q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()

    for part in (events[: len(events) // 2], events[len(events) // 2 :]):  # the second run goes on from the first one's state
        spark.createDataFrame(part, kind).repartition(2).write.mode("append").json(str(tmp_path / "in"))
        run()
    late_cache = {s for s, n in cached if n > 1000}
    for s, outcome in want.items():
        last = told[s][-1]
        assert last == outcome or (s in late_cache and last in [*order, "failed"])  # a file may turn up after the end
        assert sum(x not in ("next",) for x in told[s]) == 1
