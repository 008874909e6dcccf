"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasieve.llm.byte_bpe import round_trips
from metasieve.llm.collocations import mine_phrases
from metasieve.llm.common import scratch, stored
from metasieve.llm.conversation_repair import repair_conversations
from metasieve.llm.decontam import find_leaks
from metasieve.llm.exact_dedup import exact_dedup
from metasieve.llm.line_dedup import dedup_lines
from metasieve.llm.ngram_join import jaccard_components
from metasieve.llm.quality_knn import fit_quality, score_quality
from metasieve.llm.sstable import read_sstables, write_sstables
from metasieve.llm.superminhash import near_components
from metasieve.llm.token_rollup import TokenRollup, changes, count_tokens
from metasieve.llm.toxicity_kn import fit_toxicity, score_toxicity
from metasieve.llm.url_filter import LIMIT, RULES, STRICT, TERMS, filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_sstable_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sstables")
    write_sstables(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, path)
    read = read_sstables(spark, path)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the whole table, which it reaches by signed batches.

    All documents come in under counts of their words; those counts are then revised to tokens; the documents of over 500
    tokens are deleted and come back; each batch is replayed, two folds lie between them.
    """
    version = "byte_bpe_50k"
    docs = _table(spark, sf_dir, "documents")
    counted = stored(count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, version), "counted")
    rough = counted.select("source", "lang", "tokenizer", F.col("n_words").alias("n_tokens"))
    long = counted.filter("n_tokens > 500")
    rollup = TokenRollup(spark, scratch(spark, "token-rollup"))
    steps = [("arrived", changes(inserted=rough)), ("revised", changes(inserted=counted, deleted=rough)), ("gone", changes(deleted=long)), ("back", changes(inserted=long))]
    for k, (name, signed) in enumerate(steps):
        rollup.commit(name, signed)
        rollup.commit(name, signed)  # a replay, which finds the commit and changes nothing
        if k % 2:
            rollup.fold()
    return rollup.totals()


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return round_trips(_table(spark, sf_dir, "documents"), ranks, pattern)


def op8_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sstable_output": op2_sstable_output,
    "op3_token_rollup": op3_token_rollup,
    "op4_quality_knn": op4_quality_knn,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_toxicity_kn": op8_toxicity_kn,
    "op9_url_filter": op9_url_filter,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_superminhash": op11_superminhash,
    "op12_collocations": op12_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}

_WS = r"[\x20\x09-\x0D]+"
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rn, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM t),
k AS (SELECT rn, doc_id, line, pos, {_AZ.format(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rn) >= 5),
m AS (SELECT k.rn, k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rn, doc_id
"""

EXACT_DEDUP_SQL = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""

COLLOCATIONS_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rn, coalesce(lang, 'und') AS lang, regexp_split_to_array({_AZ.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT rn, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pn FROM t),
q AS (SELECT rn, lang, pn, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda s: s <> '') AS ws FROM p),
w AS (SELECT rn, lang, pn, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM q),
g AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rn, pn ORDER BY i)),
f1 AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k FROM f2 JOIN f1 x USING (lang, w1) JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
       WHERE NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
         AND NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.f >= 50 * f2.f)),
c3 AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, x.f AS x1, y.f AS y2, u.f AS u2, v.f AS v1
       FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
       JOIN f2 u ON u.lang = f3.lang AND u.w1 = f3.w1 AND u.w2 = f3.w2 JOIN f1 v ON v.lang = f3.lang AND v.w1 = f3.w3),
c AS (SELECT lang, phrase, a, l, r, k FROM c2 UNION ALL SELECT lang, phrase, a, x1, y2, 1 FROM c3 UNION ALL SELECT lang, phrase, a, u2, v1, 2 FROM c3),
s AS (SELECT *, 1000000 * a * a // (l * r) AS score FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE cut = 1)
SELECT z.lang, z.rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, m.n, score::BIGINT AS score
FROM z JOIN (SELECT lang, count(*) AS n FROM g GROUP BY lang) m USING (lang) WHERE z.rank <= 2000
"""


def _url_filter_sql() -> str:
    def sum_of(weights) -> str:
        return " + ".join(f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {w} ELSE 0 END" for t, w in weights.items())

    soft = {t: w for t, w in TERMS.items() if w != STRICT}
    fits = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for h, p, v in RULES)
    strict = " + ".join(f"CAST(len(regexp_extract_all(regexp_replace(u, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9]){t.replace('-', '--')}([^a-z0-9]|$)')) AS INTEGER)" for t, w in TERMS.items() if w == STRICT)
    host = _AZ.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
    return rf"""
WITH r AS ({fits}),
p AS (SELECT page_id, {host} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, {_AZ.format("coalesce(url, '')")} AS u FROM pages),
c AS (SELECT page_id, host, path, {strict} AS strict_hits, {sum_of(dict.fromkeys(soft, 1))} AS soft_hits, {sum_of(soft)} AS soft_weight FROM p),
b AS (SELECT c.*, (SELECT max_by(struct_pack(rule := h || p, verdict := v), length(h || p)) FROM r WHERE (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p)) AS best FROM c)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN strict_hits > 0 OR soft_weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits, soft_weight
FROM b
"""


ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": LINE_DEDUP_SQL,
    "op9_url_filter": _url_filter_sql(),
    "op10_exact_dedup": EXACT_DEDUP_SQL,
    "op12_collocations": COLLOCATIONS_SQL,
}
