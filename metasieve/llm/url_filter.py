"""URL filter: host and path rules, then a weighted vocabulary found with one Aho-Corasick pass.

The vocabulary has strict terms, of which one hit rejects, and soft terms with weights, of which several distinct hits
reject once their weights reach a limit; no soft term reaches it alone. A hit counts only between boundaries: the
characters beside it are no ASCII letters or digits. The vocabulary is a parameter, read from a table by read_terms.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metasieve.llm.common import map_batches

#: The weight that marks a strict term, and the sum of the weights of distinct soft terms that rejects.
STRICT, LIMIT = 0, 4
#: The most terms that read_terms takes, since each task holds the automaton.
MOST_TERMS = 100_000
#: Terms with their weights, by subject: 3 for words that mostly name such sites, 2 for words often met in their addresses
#: and elsewhere too, 1 for ordinary words that count only beside others.
TERMS: dict[str, int] = {
    # gambling
    "casino": STRICT, "poker": 3, "roulette": 3, "gambling": 3, "betting": 3, "bets": 3, "jackpot": 3, "sportsbook": 3, "bet": 2, "slots": 2, "blackjack": 2, "bingo": 2, "lottery": 2, "win": 1, "spin": 1, "bonus": 1,
    # sexual content
    "porn": STRICT, "xxx": STRICT, "escorts": STRICT, "milf": STRICT, "sex": 3, "nude": 3, "nudes": 3, "erotic": 3, "hentai": 3, "fetish": 3, "adult": 2, "dating": 2, "camgirls": 3, "hookup": 3, "singles": 1, "hot": 1, "girls": 1, "cam": 1,
    # medicines sold by spam
    "viagra": STRICT, "cialis": STRICT, "pills": 3, "tramadol": 3, "xanax": 3, "pharmacy": 2, "rx": 2, "steroids": 2, "prescription": 1, "diet": 1, "cure": 1,
    # copies and cracks
    "warez": STRICT, "keygen": STRICT, "torrent": 3, "torrents": 3, "nulled": 3, "crack": 2, "cracked": 3, "serial": 1, "mp3": 1, "download": 1,
    # money and link spam
    "loan": 3, "loans": 3, "payday": 3, "replica": 3, "spam": 3, "backlinks": 3, "forex": 2, "casinos": 3, "ads": 2, "popup": 2, "clickbait": 3, "cheap": 1, "free": 1, "farm": 1, "cash": 1, "deals": 1, "track": 1, "prize": 1, "discount": 1,
}
#: (host, path, verdict) of the contract: fixed values.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM = frozenset(LOWER + "0123456789")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null if none: the rules are literals, so no join is needed.

    Ties in length go to the longer host, then to the smaller rule text.
    """
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def checked_terms(terms: Mapping[str, int], limit: int) -> tuple[tuple[str, int], ...]:
    """(term, weight) in order; an empty term or one with A-Z is refused, and a weight that is neither STRICT nor below limit."""
    for term, weight in terms.items():
        if not term or term != term.translate(str.maketrans(UPPER, LOWER)):
            raise ValueError(f"a term has to be lower-cased and not empty: {term!r}")
        if weight is None or (weight != STRICT and not 0 < weight < limit):
            raise ValueError(f"the weight of {term!r} has to be {STRICT} (strict) or from 1 to {limit - 1}: {weight}")
    return tuple(sorted(terms.items()))


def read_terms(spark: SparkSession, path: str) -> dict[str, int]:
    """The vocabulary of a file of lines `term<TAB>weight` (or `term<TAB>strict`), in any place that Spark reads.

    A-Z of terms are lower-cased, blank terms left out; of a repeated term strict wins, then the larger weight. A weight
    that is no number, and more than MOST_TERMS terms, are errors.
    """
    lines = spark.read.csv(path, sep="\t", schema="term string, weight string", quote="", escape="")
    term = F.translate(F.trim("term"), UPPER, LOWER)
    weight = F.when(F.trim("weight") == "strict", F.lit(STRICT)).otherwise(F.trim("weight").cast("int"))
    rows = lines.select(term.alias("term"), weight.alias("weight")).where("term <> ''").groupBy("term").agg(F.when(F.min("weight") == STRICT, STRICT).otherwise(F.max("weight")).alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"{path} has more than {MOST_TERMS} terms")
    return {r.term: r.weight for r in rows}


@lru_cache(maxsize=4)
def automaton(terms: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (term, weight) in enumerate(terms):
        found.add_word(term, (len(term), k, weight))
    if terms:
        found.make_automaton()
    return found


def hits(url: str, terms: ahocorasick.Automaton) -> tuple[int, int, int]:
    """(strict hits, distinct soft terms, their weights) of a lower-cased url, between boundaries."""
    strict, soft, end = 0, {}, len(url) - 1
    for last, (n, k, weight) in terms.iter(url) if len(terms) else ():
        if (last == n - 1 or url[last - n] not in ALNUM) and (last == end or url[last + 1] not in ALNUM):
            if weight == STRICT:
                strict += 1
            else:
                soft[k] = weight
    return strict, len(soft), sum(soft.values())


def filter_urls(pages: DataFrame, terms: Mapping[str, int] = TERMS, limit: int = LIMIT, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight for every row of pages (page_id, url).

    A fitting rule decides; else the url is blocked with one strict hit, or with distinct soft terms whose weights reach
    limit. Every soft weight lies below limit, so that one soft term never blocks alone. A null or empty url has empty
    host and path, no hits and is allowed. Repeated rows give repeated results, urls of any length are read whole. Other
    columns of pages are not read.
    """
    vocabulary = checked_terms(terms, limit)

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        words, lower = automaton(vocabulary), str.maketrans(UPPER, LOWER)
        found = [hits((u or "").translate(lower), words) for u in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([x[k] for x in found], pa.int32()) for k in range(3))], ["page_id", "url", "strict_hits", "soft_hits", "soft_weight"])

    kind = pages.schema["page_id"].dataType.simpleString()
    counted = map_batches(pages.select("page_id", F.col("url").cast("string")), count, f"page_id {kind}, url string, strict_hits int, soft_hits int, soft_weight int")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = counted.select("page_id", host.alias("host"), path.alias("path"), "strict_hits", "soft_hits", "soft_weight")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_weight") >= limit), "block").otherwise("allow")
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "strict_hits", "soft_hits", "soft_weight")
