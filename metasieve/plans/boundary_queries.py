"""Queries of the sources, the model boundary and whole analyses over the benchmark tables; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasieve.functions import text as tx
from metasieve.operators import analysis, harmonize, screening, writing
from metasieve.plans import extraction, manuscript
from metasieve.plans.bindings import ARMS, arms, plain, run_sql
from metasieve.plans.queries import SMD, TCRIT, A, extraction_rows, pool_sql, query, table
from metasieve.plans.review import new_run
from metasieve.sources import documents, paged, tables

# ---- paged sources ---------------------------------------------------------------------------------------------------


def _article(docs: DataFrame) -> DataFrame:
    """pmid, xml: a document as the article that a fetch would give."""
    safe = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID Version=\"1\">"), F.col("doc_id"), F.lit("</PMID><Article><ArticleTitle>Title "), F.col("doc_id"), F.lit("</ArticleTitle><Abstract><AbstractText Label=\"TEXT\">"), safe,
        F.lit("</AbstractText></Abstract><AuthorList><Author><LastName>L"), F.col("doc_id") % 7, F.lit("</LastName>"), F.when(F.col("doc_id") % 2 == 0, "<ForeName>F</ForeName>").otherwise(""), F.lit("</Author></AuthorList>"),
        F.lit("<Journal><Title>"), F.coalesce("source", F.lit("")), F.lit("</Title><JournalIssue><PubDate><MedlineDate>Spring "), F.col("doc_id") % 50 + 1970, F.lit("</MedlineDate></PubDate></JournalIssue></Journal>"),
        F.lit("<ELocationID EIdType=\"pii\">x</ELocationID><ELocationID EIdType=\"doi\">10.1/"), F.col("doc_id"), F.lit("</ELocationID></Article></MedlineCitation></PubmedArticle>"),
    )
    return docs.select(F.col("doc_id").cast("string").alias("pmid"), xml.alias("xml"))


@query("""WITH b AS (SELECT doc_id, source, lang AS query, coalesce(text, '') AS t, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 200 AS batch FROM documents),
dead AS (SELECT DISTINCT query FROM b WHERE query = (SELECT max(lang) FROM documents))
SELECT query, CAST(batch AS INT) AS batch, concat('PMID_', doc_id) AS study_id, concat('Title ', doc_id) AS title, md5(trim(concat('TEXT: ', trim(t, chr(9) || chr(10) || chr(13) || ' ')))) AS abstract_md5,
  CASE WHEN doc_id % 2 = 0 THEN concat('L', doc_id % 7, ', F') ELSE concat('L', doc_id % 7) END AS author, CAST(doc_id % 50 + 1970 AS VARCHAR) AS year, concat('10.1/', doc_id) AS doi, source AS journal
FROM b WHERE query NOT IN (SELECT query FROM dead)""")
def pubmed_batches(spark, sf_dir):
    """Ids of documents, a query for each language, fetched in batches of 200; the last language's first fetch fails."""
    docs = table(spark, sf_dir, "documents")
    ids = docs.select(F.col("lang").alias("query"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("pmid"))
    last = docs.agg(F.max("lang").alias("last"))

    def fetch(batches: DataFrame) -> DataFrame:
        asked = batches.select("query", "batch", F.explode("ids").alias("pmid")).join(_article(docs), "pmid")
        bodies = asked.groupBy("query", "batch").agg(F.concat(F.lit("<PubmedArticleSet>"), F.array_join(F.collect_list("xml"), ""), F.lit("</PubmedArticleSet>")).alias("body"))
        return bodies.join(F.broadcast(last)).filter(~((F.col("query") == F.col("last")) & (F.col("batch") == 0))).drop("last")

    found = paged.fetch_details(paged.id_batches(ids, most=2**31 - 1), fetch)
    text = F.regexp_replace(F.regexp_replace(F.substring(F.col("abstract"), 7, 2**31 - 1), r"^[\t\n\r ]+", ""), r"[\t\n\r ]+$", "")
    return found.select("query", "batch", "study_id", "title", F.md5(F.concat(F.lit("TEXT: "), text)).alias("abstract_md5"), F.get("authors", F.lit(0)).alias("author"), "year", "doi", "journal")


_STUDIES = "doc_id AS study_id, CASE WHEN doc_id % 3 <> 0 THEN concat('10.1/', doc_id) ELSE '' END AS doi, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS {s}) END AS pmid, CASE WHEN doc_id % 5 = 0 THEN concat('PMC', doc_id) ELSE '' END AS pmcid"
_BODIES = """CASE source WHEN 'unpaywall' THEN CASE study_id % 4 WHEN 1 THEN concat('{"best_oa_location": {"url_for_pdf": "u', study_id, '"}}') WHEN 2 THEN concat('{"best_oa_location": null, "oa_locations": [{"url": ""}, {"url": "l', study_id, '"}]}') WHEN 3 THEN 'sorry' END
  WHEN 'europepmc' THEN CASE WHEN study_id % 4 = 0 THEN concat('{"resultList": {"result": [{"pmcid": ""}, {"pmcid": "PMC9', study_id, '"}]}}') ELSE '{"resultList": {"result": []}}' END
  WHEN 'semantic_scholar' THEN CASE WHEN study_id % 7 < 3 THEN concat('{"openAccessPdf": {"url": "s', study_id, '"}}') ELSE '{"openAccessPdf": null}' END END"""
_URLS = f"""WITH st AS (SELECT {_STUDIES.format(s="VARCHAR")} FROM documents),
c AS (SELECT study_id, 'unpaywall' AS source, 0 AS priority FROM st WHERE doi <> '' UNION ALL SELECT study_id, 'pmc', 1 FROM st WHERE pmcid <> '' UNION ALL SELECT study_id, 'europepmc', 2 FROM st WHERE pmid IS NOT NULL
  UNION ALL SELECT study_id, 'semantic_scholar', 3 FROM st WHERE doi <> '' UNION ALL SELECT study_id, 'doi_redirect', 4 FROM st WHERE doi <> ''),
u AS (SELECT study_id, source, priority, CASE source WHEN 'pmc' THEN concat('https://www.ncbi.nlm.nih.gov/pmc/articles/PMC', study_id, '/pdf/') WHEN 'doi_redirect' THEN concat('https://doi.org/10.1/', study_id)
  WHEN 'unpaywall' THEN CASE study_id % 4 WHEN 1 THEN concat('u', study_id) WHEN 2 THEN concat('l', study_id) END WHEN 'europepmc' THEN CASE WHEN study_id % 4 = 0 THEN concat('https://www.ncbi.nlm.nih.gov/pmc/articles/PMC9', study_id, '/pdf/') END
  WHEN 'semantic_scholar' THEN CASE WHEN study_id % 7 < 3 THEN concat('s', study_id) END END AS url FROM c)"""


def _urls(spark, sf_dir) -> DataFrame:
    studies = table(spark, sf_dir, "documents").selectExpr(*(x for x in _STUDIES.format(s="STRING").replace(", CASE", "\nCASE").split("\n")))
    answers = documents.candidates(studies).filter("asks IS NOT NULL").select("asks", F.expr(_BODIES).alias("body"))
    return documents.candidate_urls(studies, answers)


@query(f"{_URLS} SELECT * FROM u WHERE url IS NOT NULL")
def download_candidates(spark, sf_dir):
    """Studies with some identifiers each, and scripted answers of the lookups."""
    return _urls(spark, sf_dir)


_FETCHED = "CASE WHEN (study_id + priority * 3) % 4 = 0 THEN 404 ELSE 200 END AS status, (study_id * 13 + priority * 501) % 3000 AS length, CASE WHEN study_id % 3 = 0 THEN 'application/pdf' ELSE 'text/html' END AS content_type, CASE WHEN (study_id + priority) % 2 = 0 THEN '%PDF-' END AS head"


@query(f"""{_URLS}, f AS (SELECT study_id, source, priority, {_FETCHED} FROM u WHERE url IS NOT NULL),
v AS (SELECT *, status = 200 AND length > 1000 AND (contains(content_type, 'pdf') OR coalesce(head, '') = '%PDF-') AS ok FROM f)
SELECT study_id, CASE WHEN study_id % 10 = 0 AND study_id % 1700 > 1000 THEN 'cached' WHEN bool_or(ok) THEN min_by(source, priority) FILTER (WHERE ok) ELSE 'failed' END AS outcome FROM v GROUP BY study_id""")
def download_cascade(spark, sf_dir):
    """Scripted answers of every source; each tenth study has a file at hand, of some size."""
    urls = _urls(spark, sf_dir)
    fetched = urls.select("study_id", "source", *(F.expr(x) for x in _FETCHED.replace(", CASE", "\nCASE").replace(", (", "\n(").split("\n")))
    cached = table(spark, sf_dir, "documents").filter("doc_id % 10 = 0").selectExpr("doc_id AS study_id", "doc_id % 1700 AS length")
    return documents.downloaded(urls, fetched, cached)


# ---- the model boundary ----------------------------------------------------------------------------------------------

_ITEM = "concat('{\"outcome_name\": \"o', o_orderkey, '\", \"n\": ', o_custkey, '}')"
_SHAPES = f"""CASE o_orderkey % 9 WHEN 0 THEN concat('[', {_ITEM}, ', {{"n": 2}}]') WHEN 1 THEN concat('{{"extractions": [', {_ITEM}, ']}}') WHEN 2 THEN concat('```json\\n{{"outcomes": [', {_ITEM}, ', {{"n": 2}}]}}\\n```')
  WHEN 3 THEN {_ITEM} WHEN 4 THEN concat('{{"outcomes": ', {_ITEM}, '}}') WHEN 5 THEN '{{"extractions": null, "outcomes": [1]}}' WHEN 6 THEN concat('Here: ', {_ITEM}) WHEN 7 THEN '[]' ELSE concat('{{"outcomes": [1], "extractions": [', {_ITEM}, ']}}') END"""


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (0, 2) THEN 2 WHEN o_orderkey % 9 IN (5, 6) THEN NULL WHEN o_orderkey % 9 = 7 THEN 0 ELSE 1 END AS n_items,
  CASE WHEN o_orderkey % 9 NOT IN (5, 6, 7) THEN concat('o', o_orderkey) END AS outcome_name, CASE WHEN o_orderkey % 9 NOT IN (5, 6, 7) THEN o_custkey END AS n FROM orders""")
def coerced_answers(spark, sf_dir):
    """Answers of nine shapes."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", tx.items(tx.answer(F.expr(_SHAPES)), "extractions", "outcomes").alias("i"))
    first = F.from_json(F.get("i", F.lit(0)), "outcome_name string, n bigint")
    return rows.select("o_orderkey", F.when(F.col("i").isNotNull(), F.size("i")).alias("n_items"), first["outcome_name"].alias("outcome_name"), first["n"].alias("n"))


#: Whether a scripted answer is broken, by study k, round r, attempt a and try t.
_BROKEN = "({k} * 7 + {r} * 3 + {a} * 5 + {t} * 2 + {k} // 11 * {r}) % 5 < 2"


def _scripted(asked: DataFrame) -> DataFrame:
    """key, attempt, response: answers that follow from the prompt, of which some are broken."""
    k, r = "CAST(key AS BIGINT)", "CAST(right(phase, 1) AS INT)"
    rows = asked.withColumnRenamed("attempt", "a").withColumn("attempt", F.explode(F.array(F.lit(2), F.lit(1), F.lit(3))))
    n_outcomes = r"size(from_json(regexp_extract(user, '## Outcomes to Extract\n([^\n]*)', 1), 'array<string>'))"
    n_rows = r"size(from_json(regexp_extract(user, '## Extracted Data\n([^\n]*)', 1), 'array<string>'))"
    row = "'{\"arm1\": {\"n\": 1, \"mean\": null}}'"
    listed = lambda n, item: f"concat('[', array_join(array_repeat({item}, {n}), ','), ']')"
    answer = f"""CASE {r} WHEN 1 THEN concat('{{"primary_outcomes": ', CASE WHEN {k} % 4 = 0 THEN 'null' ELSE {listed(f"CAST({k} % 3 AS INT)", "'\"x\"'")} END, ', "secondary_outcomes": ["y"]}}')
      WHEN 2 THEN CASE {k} % 3 WHEN 0 THEN {listed(n_outcomes, row)} WHEN 1 THEN concat('{{"extractions": ', {listed(n_outcomes, row)}, '}}') ELSE concat('{{"outcomes": ', {listed(n_outcomes, row)}, '}}') END
      WHEN 3 THEN CASE WHEN {k} % 50 = 9 THEN '[]' ELSE concat('{{"checks_passed": ', {k} % 2 = 0, ', "issues": ', {listed(n_rows, "'1'")}, '}}') END
      ELSE concat('{{"spans": ', {listed(n_rows, "concat('{\"match_confidence\": 0.', CAST(key AS BIGINT) % 10, '}')")}, '}}') END"""
    broken = f"pmod({k} * 7 + {r} * 3 + a * 5 + attempt * 2 + {k} div 11 * {r}, 5) < 2"
    return rows.select("key", "attempt", F.expr(f"CASE WHEN attempt < 3 AND {broken} THEN 'I am sorry' ELSE {answer} END").alias("response"))


@query(f"""WITH s AS (SELECT doc_id AS k FROM documents), g AS (SELECT k, a, r, NOT ({_BROKEN.format(k="k", r="r", a="a", t=1)}) OR NOT ({_BROKEN.format(k="k", r="r", a="a", t=2)}) AS parses
  FROM s, (VALUES (1), (2)) x(a), (VALUES (1), (2), (3), (4)) y(r)),
f AS (SELECT k, a, coalesce(min(r) FILTER (WHERE NOT parses OR (r = 3 AND k % 50 = 9)), 5) AS bad FROM g GROUP BY k, a),
d AS (SELECT x.k, CASE WHEN x.bad = 5 THEN 1 ELSE 2 END AS attempts, CASE WHEN x.bad = 5 THEN 5 ELSE y.bad END AS bad FROM f x JOIN f y ON x.k = y.k AND x.a = 1 AND y.a = 2),
e AS (SELECT d.*, g.parses FROM d LEFT JOIN g ON g.k = d.k AND g.a = d.attempts AND g.r = d.bad),
n AS (SELECT *, 1 + CASE WHEN k % 4 = 0 THEN 0 ELSE k % 3 END AS n FROM e)
SELECT k AS study_id, attempts, bad - 1 AS rounds_completed, CASE WHEN bad = 5 THEN n END AS n_outcomes, CASE WHEN bad = 5 THEN n END AS n_extractions, CASE WHEN bad = 5 THEN k % 2 = 0 END AS checks_passed, CASE WHEN bad = 5 THEN n END AS n_issues,
  CASE WHEN bad = 5 THEN n END AS n_spans, CASE WHEN bad = 5 THEN CASE WHEN k % 10 < 7 THEN n ELSE 0 END END AS n_low,
  CASE WHEN bad < 5 THEN concat('round ', bad, CASE WHEN parses THEN ': the answer has no use' ELSE ': no answer parses' END) END AS error FROM n""")
def extraction_rounds(spark, sf_dir):
    """Four rounds over every document, with scripted answers that read their prompt."""
    studies = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("study_id"), F.col("text").alias("content"))
    found = extraction.extract(studies, "{}", _scripted, new_run(spark).keep)
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return found.select("study_id", "attempts", "rounds_completed", n("outcomes").alias("n_outcomes"), n("extractions").alias("n_extractions"), "checks_passed", "n_issues", n("evidence_spans").alias("n_spans"), n("low_confidence_spans").alias("n_low"), "error")


@query("""WITH t AS (SELECT doc_id AS study_id, lang, source, length(coalesce(text, '')) // 3 + 20 AS tokens, floor((sum(length(coalesce(text, '')) // 3 + 20) OVER (PARTITION BY source ORDER BY doc_id) - (length(coalesce(text, '')) // 3 + 20)) / 8000) AS batch FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source, batch ORDER BY study_id) - 1 AS place, count(*) OVER (PARTITION BY source, batch) AS n FROM t),
v AS (SELECT *, batch % 5 = 3 OR (batch % 5 = 2 AND place >= n - 2) AS missing FROM p)
SELECT study_id, 'screener1' AS screener_id, CASE WHEN missing OR (place + batch) % 3 = 0 THEN 'include' ELSE 'exclude' END AS decision, CASE WHEN missing THEN 0 WHEN (place + batch) % 7 = 0 THEN 100 ELSE CAST((place * 13) % 101 AS INT) END AS confidence, missing AS parse_error FROM v""")
def batch_screening(spark, sf_dir):
    """Documents of each source packed into prompts of 8000 tokens; some answers are broken, some two votes short."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("study_id"), "source", F.lit("t").alias("title"), F.col("text").alias("abstract"))
    packed = extraction.pack(rows, "source", "study_id", F.expr("length(coalesce(abstract, '')) div 3 + 20"), 8000)
    asked = extraction.screening_prompts(packed, "source", "{}", "{}")
    vote = "concat('{\"decision\": \"', CASE WHEN (p + batch) % 3 = 0 THEN 'Include' ELSE 'exclude ' END, '\", \"confidence\": ', CASE WHEN (p + batch) % 7 = 0 THEN 130 ELSE (p * 13) % 101 END, '}')"
    places = "CASE WHEN batch % 5 = 2 THEN CASE WHEN n > 2 THEN sequence(0, n - 3) ELSE array() END ELSE sequence(0, n - 1) END"
    answers = asked.withColumn("n", F.expr(r"size(regexp_extract_all(user, '(?m)^### \\d+\nTitle: t\n', 0))")).select("source", "batch", F.expr(f"CASE WHEN batch % 5 = 3 THEN 'oops' ELSE concat('{{\"votes\": [', array_join(transform({places}, p -> {vote}), ','), ']}}') END").alias("response"))
    return extraction.batch_votes(packed, "source", answers, "screener1")


# ---- harmonization ---------------------------------------------------------------------------------------------------

_SPELLED = "CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN concat(' ', n_name, ' ') ELSE concat(upper(substring(n_name, 1, 1)), lower(substring(n_name, 2, 30))) END"


@query(f"""WITH r AS (SELECT c_custkey, n_nationkey, {_SPELLED} AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT n_nationkey, raw, min(c_custkey) AS o FROM r GROUP BY ALL),
k AS (SELECT n_nationkey, arg_min(raw, struct_pack(n := CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE length(raw) END, o := o)) AS canonical, count(*) AS n_members FROM f GROUP BY n_nationkey)
SELECT c_custkey, canonical AS canonical_outcome, n_members FROM r JOIN k USING (n_nationkey)""")
def harmonize_names(spark, sf_dir):
    """Customers' nations in four spellings; a fifth of the nations have no vectors, so spelling alone joins their names."""
    nations = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = nations.select("c_custkey", "n_nationkey", F.col("c_custkey").alias("ord"), F.expr(_SPELLED).alias("outcome_name"))
    # a nation's vector is its own direction, a little turned by the spelling
    known = rows.filter("n_nationkey % 5 <> 0").groupBy(F.col("outcome_name").alias("name")).agg(F.min("n_nationkey").alias("k"), F.min(F.length("outcome_name")).alias("n"))
    vectors = known.select("name", F.expr("transform(sequence(0, 24), i -> CASE WHEN i = k THEN 1.0D WHEN i = n % 25 THEN 0.1D ELSE 0.0D END)").alias("vector"))
    clusters, data, _ = harmonize.harmonize(rows, vectors)
    sizes = clusters.select("canonical", F.size("members").cast("long").alias("n_members"))
    return data.join(sizes, F.col("canonical_outcome") == F.col("canonical")).select("c_custkey", "canonical_outcome", "n_members")


# ---- whole analyses --------------------------------------------------------------------------------------------------

#: The effects that extraction_rows() leads to: standardised differences, and odds for the binary outcome.
_ANY = f"""{SMD}, lo AS (SELECT *, ln((events1 * 1.0 * (n2 - events2)) / ((n1 - events1) * 1.0 * events2)) AS e, sqrt(1.0 / events1 + 1.0 / (n1 - events1) + 1.0 / events2 + 1.0 / (n2 - events2)) AS s FROM arms WHERE events1 > 0 AND events2 > 0 AND n1 > events1 AND n2 > events2),
anyeff AS (SELECT outcome, ord, study_id, subgroup, effect, se FROM eff WHERE substring(outcome, 1, 1) <> '3' UNION ALL SELECT outcome, ord, study_id, subgroup, e, s FROM lo WHERE substring(outcome, 1, 1) = '3')"""
_RESULT = ("pooled_effect", "pooled_se", "ci_lower", "ci_upper", "tau2", "i2", "q")


def _dl_analysis(spark, sf_dir) -> dict[str, DataFrame]:
    rows = extraction_rows(spark, sf_dir)
    plan = analysis.default_plan(analysis.data_profile(rows)).withColumn("method", F.lit("DL"))
    return analysis.analyze(rows, plan)


@query(f"WITH {_ANY}, {TCRIT}, {pool_sql('anyeff', 'outcome')} SELECT outcome, CASE WHEN substring(outcome, 1, 1) = '3' THEN 'logOR' ELSE 'SMD' END AS effect_type, k, k >= 2 AS has_loo, {', '.join(f'round({c}, 5) AS {c}' for c in _RESULT)} FROM pooled")
def analyze_dl(spark, sf_dir):
    """The whole analysis under a plan that pools by DerSimonian and Laird."""
    r = _dl_analysis(spark, sf_dir)["results"]
    return r.select("outcome", "effect_type", "k", "has_loo", *(F.round(c, 5).alias(c) for c in _RESULT))


@query(f"WITH {_ANY}, {TCRIT}, {pool_sql('anyeff', 'outcome', 'subgroup')} SELECT outcome, 'subgroup_region' AS variable, subgroup, k, {', '.join(f'round({c}, 5) AS {c}' for c in _RESULT)} FROM pooled")
def analyze_subgroups(spark, sf_dir):
    """The planned subgroups of the same analysis."""
    s = _dl_analysis(spark, sf_dir)["subgroups"]
    return s.select("outcome", "variable", "subgroup", "k", *(F.round(c, 5).alias(c) for c in _RESULT))


_KIND = "CASE ord % 6 WHEN 0 THEN 'SMD' WHEN 1 THEN 'MD' WHEN 2 THEN 'logRR' WHEN 3 THEN 'logOR' WHEN 4 THEN 'RD' ELSE 'HR' END"
_DAMAGED = f"""SELECT concat(outcome, '/', {_KIND}) AS outcome, ord, study_id, {_KIND} AS effect_type, CASE WHEN ord % 7 <> 3 THEN n1 END AS n1, n2, CASE WHEN ord % 8 <> 1 THEN mean1 END AS mean1, mean2,
  CASE WHEN ord % 8 <> 1 THEN sd1 * CASE WHEN ord = 12 THEN 0 ELSE 1 END END AS sd1, CASE WHEN ord % 11 <> 6 THEN sd2 * CASE WHEN ord = 12 THEN 0 ELSE 1 END END AS sd2,
  CASE WHEN ord % 8 <> 1 AND ord <> 14 THEN CASE WHEN ord = 15 THEN n1 ELSE events1 END END AS events1, CASE WHEN ord = 20 THEN 0 ELSE events2 END AS events2 FROM arms"""


@query(f"""WITH {A}, d AS ({_DAMAGED}),
m AS (SELECT *, list_filter(CASE WHEN effect_type IN ('SMD', 'MD') THEN [CASE WHEN n1 IS NULL THEN 'arm1.n' END, CASE WHEN mean1 IS NULL THEN 'arm1.mean' END, CASE WHEN sd1 IS NULL THEN 'arm1.sd' END, CASE WHEN n2 IS NULL THEN 'arm2.n' END, CASE WHEN mean2 IS NULL THEN 'arm2.mean' END, CASE WHEN sd2 IS NULL THEN 'arm2.sd' END]
  ELSE [CASE WHEN events1 IS NULL THEN 'arm1.events' END, CASE WHEN n1 IS NULL THEN 'arm1.total' END, CASE WHEN events2 IS NULL THEN 'arm2.events' END, CASE WHEN n2 IS NULL THEN 'arm2.total' END] END, lambda x: x IS NOT NULL) AS missing FROM d),
r AS (SELECT *, coalesce(mean1, sd1, events1) IS NULL AS none, CASE WHEN len(missing) > 0 THEN NULL WHEN effect_type = 'SMD' AND sd1 * sd1 * (n1 - 1) + sd2 * sd2 * (n2 - 1) > 0 THEN
    (mean1 - mean2) / sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / (n1 + n2 - 2)) * (1 - 3.0 / (4 * (n1 + n2 - 2) - 1))
  WHEN effect_type = 'MD' THEN mean1 - mean2 WHEN effect_type = 'logRR' AND events1 > 0 AND events2 > 0 THEN ln((events1 * 1.0 / n1) / (events2 * 1.0 / n2))
  WHEN effect_type = 'logOR' AND events1 > 0 AND events2 > 0 AND n1 > events1 AND n2 > events2 THEN ln((events1 * 1.0 * (n2 - events2)) / ((n1 - events1) * 1.0 * events2)) WHEN effect_type = 'RD' THEN events1 * 1.0 / n1 - events2 * 1.0 / n2 END AS e FROM m)
SELECT outcome, ord, effect_type, CASE WHEN NOT none THEN round(e, 6) END AS effect, CASE WHEN none THEN 'no data' WHEN effect_type = 'HR' THEN 'unknown effect type' WHEN len(missing) > 0 THEN concat('missing: ', array_to_string(missing, ', ')) WHEN e IS NULL THEN 'outside the domain' END AS reason FROM r""")
def judged_rows(spark, sf_dir):
    """Every row under a type of its own, some damaged: its effect, or why it has none."""
    d = run_sql(spark, sf_dir, f"WITH {A.replace(plain(ARMS), ARMS)} {_DAMAGED}")
    arm = lambda k: F.struct(*(F.col(f"{f}{k}").cast(t).alias(f) if f in ("n", "mean", "sd", "events") else F.lit(None).cast(t).alias(f) for f, t in (("n", "long"), ("mean", "double"), ("sd", "double"), ("se", "double"), ("ci_lower", "double"), ("ci_upper", "double"), ("events", "long"))), F.col(f"n{k}").cast("long").alias("total"))
    plan = d.select("outcome", "effect_type").distinct().withColumns({"method": F.lit("DL"), "apply_hksj": F.lit(True)})
    judged = analysis.judged_effects(d.select("outcome", "ord", "study_id", arm(1).alias("arm1"), arm(2).alias("arm2")), plan)
    return judged.select("outcome", "ord", "effect_type", F.round("effect", 6).alias("effect"), "reason")


@query(f"""WITH {A}, r AS (SELECT study_id, outcome, CASE WHEN CAST(substring(outcome, 1, 1) AS INT) > 3 THEN 'late' END AS timepoint, ord, CASE WHEN ord % 3 = 0 THEN n1 ELSE 100 END AS n1, CASE WHEN ord % 5 = 0 THEN NULL ELSE 100 END AS n2, mean1, mean2, sd1, sd2 FROM arms),
s AS (SELECT study_id, timepoint, coalesce(min(n1) <> max(n1), false) OR coalesce(min(n2) <> max(n2), false) AS differs FROM r GROUP BY study_id, timepoint)
SELECT r.study_id, r.outcome, r.timepoint, ord, array_to_string(list_filter([CASE WHEN differs THEN 'n_differs' END, CASE WHEN substring(outcome, 1, 1) <> '5' AND (mean1 < 36000 OR mean1 > 39000 OR mean2 < 36000 OR mean2 > 39000) THEN 'mean_outside' END, CASE WHEN substring(outcome, 1, 1) <> '5' AND (sd1 > 1500 OR sd2 > 1500) THEN 'sd_implausible' END], lambda x: x IS NOT NULL), ',') AS issues
FROM r JOIN s ON r.study_id = s.study_id AND r.timepoint IS NOT DISTINCT FROM s.timepoint""")
def cross_check_rows(spark, sf_dir):
    """Two timepoints, sizes that differ between outcomes for every third study, ranges for all outcomes but one."""
    a = arms(spark, sf_dir)
    arm = lambda n, k: F.struct(n.alias("n"), F.col(f"mean{k}").alias("mean"), F.col(f"sd{k}").alias("sd"))
    rows = a.select("study_id", "outcome", F.expr("CASE WHEN CAST(substring(outcome, 1, 1) AS INT) > 3 THEN 'late' END").alias("timepoint"), "ord", arm(F.expr("CASE WHEN ord % 3 = 0 THEN n1 ELSE 100 END"), 1).alias("arm1"), arm(F.expr("CASE WHEN ord % 5 = 0 THEN NULL ELSE 100 END"), 2).alias("arm2"))
    ranges = a.filter("substring(outcome, 1, 1) <> '5'").select("outcome").distinct().withColumns({"low": F.lit(36000.0), "high": F.lit(39000.0)})
    return analysis.cross_check_rows(rows, ranges).withColumn("issues", F.array_join("issues", ","))


# ---- tables, writing, figures ----------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT page_id, length(coalesce(html, '')) AS n FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('| page | size |', chr(10), '| --- | --- |', chr(10), '| p', page_id, ' | ', n, ' |')
  WHEN 1 THEN concat('| p', page_id, ' |  | x |', chr(10), '| --- | --- | --- |', chr(10), '|  |  | ', n, ' |', chr(10), '| a & b | c |  |')
  WHEN 2 THEN concat('| inner |', chr(10), '| --- |', chr(10), chr(10), '| ', n, ' | z |', chr(10), '| --- | --- |') END AS markdown FROM p""")
def page_tables(spark, sf_dir):
    """Pages with a table of three kinds appended: plain, with spans in both directions, and one inside another."""
    n = "length(coalesce(html, ''))"
    table_of = f"""CASE page_id % 4 WHEN 0 THEN concat('<table><tr><th>page<th>size<tr><td>p', page_id, '<td>', {n}, '</table>')
      WHEN 1 THEN concat('<table><tr><td colspan=2 rowspan=2>p', page_id, '</td><td>x</td></tr><tr><td>', {n}, '</td></tr><tr><td>a &amp; b</td><td>c</td></tr></table><table><tr><td> </td></tr></table>')
      WHEN 2 THEN concat('<table><tr><td>', {n}, '</td><td><table><tr><td>inner</td></tr></table>z</td></tr></table>') ELSE '' END"""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.expr(f"concat(coalesce(html, ''), {table_of})"))
    return tables.find_tables(pages).select("page_id", tables.tables_markdown(F.col("tables")).alias("markdown"))


_FAILS = "(k * 3 + {r} * 5) % 7 = 0"


def _writer(asked: DataFrame) -> DataFrame:
    """Scripted answers: a section tells how long its prompt is, and whether it saw what it should."""
    section = "right(phase, length(phase) - 7)"
    seen = "concat(length(regexp_replace(user, '[^#]', '')), CASE WHEN contains(user, 'Statistical Results') THEN 's' ELSE '' END, CASE WHEN contains(user, 'Thesis for') THEN 't' ELSE '' END, CASE WHEN contains(user, 'could not be') THEN 'p' ELSE '' END)"
    body = f"CASE WHEN phase = 'writer_synthesis' THEN '{{\"narrative_skeleton\": {{\"results\": \"it works\"}}}}' ELSE concat('{{\"text\": \"', {section}, ' ', {seen}, '\"}}') END"
    order = "array_position(array('writer_synthesis', 'writer_methods', 'writer_results', 'writer_discussion', 'writer_introduction', 'writer_abstract'), phase)"
    return asked.select("key", F.lit(1).alias("attempt"), F.expr(f"CASE WHEN (length(key) * 3 + {order} * 5) % 7 = 0 THEN '[]' ELSE {body} END").alias("response"))


def _sections_sql() -> str:
    """The five sections from what failed before each: `#` signs of the prompt, then s, t, p for what it holds."""
    bad = lambda r: f"(k * 3 + {r} * 5) % 7 = 0"
    out = []
    for i, s in enumerate(manuscript.SECTIONS):
        marks = 2 * 3 + (2 if s in manuscript.SEE_STATISTICS else 0) + (2 + 3 * i if i else 0)
        thesis = f"CASE WHEN {bad(1)} THEN 0 ELSE 2 END" if s == "results" else "0"
        flags = [f"CASE WHEN {bad(1)} THEN '' ELSE 't' END" if s == "results" else "''", " OR ".join(f"({bad(j + 2)})" for j in range(i)) or "false"]
        out.append(f"SELECT report, '{s}' AS section, CASE WHEN {bad(i + 2)} THEN '[{s} section could not be generated]' ELSE concat('{s} ', {marks} + {thesis} + CASE WHEN q THEN 2 ELSE 0 END, '{'s' if s in manuscript.SEE_STATISTICS else ''}', {flags[0]}, CASE WHEN {flags[1]} THEN 'p' ELSE '' END) END AS text FROM r")
    return "WITH r AS (SELECT n_name AS report, length(n_name) AS k, n_nationkey % 2 = 0 AS q FROM nation) " + " UNION ALL ".join(out)


@query(_sections_sql())
def written_sections(spark, sf_dir):
    """A report for each nation, with scripted answers of which some fail."""
    reports = table(spark, sf_dir, "nation").select(F.col("n_name").alias("report"), F.lit("{}").alias("pico"), F.lit("{}").alias("statistics"), F.lit("[]").alias("extractions"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN '{\"q\": 1}' END").alias("quality"))
    return manuscript.write_sections(reports, _writer, new_run(spark).keep).select("report", "section", "text")


@query("SELECT source, concat('Records identified', chr(10), '(n = ', count(*), ')') AS first_box, count(*) FILTER (WHERE lang = 'en') AS included FROM documents GROUP BY source")
def prisma_figure(spark, sf_dir):
    """A flow for each source: its documents are identified, the English ones included."""
    n, e = F.count(F.lit(1)), F.count_if(F.col("lang") == "en")
    zero = F.lit(0).cast("long")
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(n.alias("n"), e.alias("e")).select("source", screening.prisma_counts(F.col("n"), F.col("n"), zero, F.col("n"), F.col("n") - F.col("e"), zero, F.col("e"), zero, F.col("e"), zero).alias("counts"))
    boxes = writing.prisma_layout(counts).filter("kind <> 'arrow'").groupBy("source").agg(F.max(F.when(F.col("y") == 15.0, F.col("text"))).alias("first_box"), F.max(F.when(F.col("y") == 8.2, F.regexp_extract("text", r"n = (\d+)", 1).cast("long"))).alias("included"))
    return boxes
