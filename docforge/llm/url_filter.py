"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A rule is (verdict, host, path): it fits its host and all subdomains if the url's path starts with the rule's path;
the longest fitting rule decides. Elsewhere the automaton finds every term in the lower-cased url; a hit counts where
neither neighbour is an ASCII letter or digit. Every term has a weight, and the weights of the distinct terms found are
summed: LIMIT or more blocks the url, so one strict term (weight LIMIT) or several soft ones do. The vocabulary is data:
the default one below was put together here, by subject, out of no other list; pass a dict, or read one of your own,
such as a public blocklist's terms, by ``read_vocabulary``.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is judged by its
terms (null: allow). Repeated rows are judged one by one; other columns are not read. An empty table gives no rows.
Very long urls are scanned once, in linear time. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.llm.common import fresh

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Weights summed that block a url.
LIMIT = 2
# The default vocabulary by subject, (strict terms, soft terms).
SUBJECTS = {
    "adult": (["camgirls", "hentai", "porn", "porno", "xxx"], ["adult", "erotic", "escort", "escorts", "fetish", "nude", "nudes", "sex", "sexy", "singles"]),
    "gambling": (["casino", "casinos", "gambling", "sportsbook"], ["bet", "bets", "betting", "bingo", "bonus", "jackpot", "lottery", "poker", "roulette", "slots"]),
    "drugs": (["cialis", "viagra"], ["pharmacy", "pills", "prescription", "steroids", "tramadol", "weightloss"]),
    "money": (["getrichquick"], ["cash", "credit", "crypto", "forex", "investment", "loan", "loans", "payday", "profits"]),
    "piracy": (["keygen", "keygens", "warez"], ["crack", "cracked", "nulled", "serial", "serials", "torrent", "torrents"]),
    "attacks": (["malware", "phishing"], ["exploit", "hack", "hacked", "password", "trojan"]),
    "spam": (["spam", "spamming"], ["ad", "ads", "affiliate", "banner", "cheap", "clickbait", "deals", "discount", "free", "gratis", "offer", "popup", "promo", "sale", "tracker", "winner"]),
}
VOCABULARY = {t: w for strict, soft in SUBJECTS.values() for terms, w in ((strict, LIMIT), (soft, 1)) for t in terms}
#: Bytes of a vocabulary that is read, at most: every worker holds its automaton.
VOCABULARY_BYTES = 32 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict): the longest that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Weights of terms, lower-cased, out of CSV files with a header: term, weight; of equal terms the greater weight."""
    found = spark.read.option("header", True).schema("term string, weight int").csv(path).where("trim(term) <> '' AND weight > 0")
    found = found.groupBy(F.translate(F.trim("term"), UPPER, LOWER).alias("term")).agg(F.max("weight").alias("weight"))
    size = found.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    if size > VOCABULARY_BYTES:
        raise ValueError(f"{size} bytes of terms; a vocabulary has {VOCABULARY_BYTES} at most")
    return {r.term: r.weight for r in found.collect()}


_BUILT: dict[tuple, ahocorasick.Automaton] = {}


def _automaton(vocabulary: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    if vocabulary not in _BUILT:
        made = ahocorasick.Automaton()
        for term, weight in vocabulary:
            made.add_word(term, (term, weight))
        made.make_automaton()
        _BUILT.clear()
        _BUILT[vocabulary] = made
    return _BUILT[vocabulary]


INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def hits(url: str, automaton: ahocorasick.Automaton) -> dict[str, int]:
    """Weights of the distinct terms that stand between boundaries."""
    found: dict[str, int] = {}
    for end, (term, weight) in automaton.iter(url):
        start = end - len(term) + 1
        if (start == 0 or url[start - 1] not in INSIDE) and (end + 1 == len(url) or url[end + 1] not in INSIDE):
            found[term] = weight
    return found


def term_hits(df: DataFrame, url: Column, vocabulary: dict[str, int], limit: int) -> Column:
    """struct(strict, soft, weight): how many distinct terms of each kind the url holds, and the sum of their weights."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(sorted(vocabulary.items())))

    @F.pandas_udf("strict int, soft int, weight bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(shared.value)
        for urls in batches:
            found = [list(hits(u or "", automaton).values()) if len(automaton) else [] for u in urls]
            yield pd.DataFrame({"strict": [sum(w >= limit for w in f) for f in found], "soft": [sum(w < limit for w in f) for f in found], "weight": list(map(sum, found))}).astype({"strict": "int32", "soft": "int32", "weight": "int64"})

    return count(F.translate(url, UPPER, LOWER))


def judge_urls(df: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, vocabulary: dict[str, int] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """df's columns but those of the same names, with host, path, rule, strict_hits, soft_hits, weight and verdict."""
    at = F.col(f"`{url}`")
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {"host", "path", "rule", "strict_hits", "soft_hits", "weight", "verdict"}]
    by_rule, found = fresh(df, "_rule_verdict"), fresh(df, "_hits")
    host, path = host_of(at), path_of(at)
    rule, verdict = rule_of(host, path, rules)
    out = df.select(*keep, host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias(by_rule), term_hits(df, at, vocabulary, limit).alias(found))
    by_terms = F.when(F.col(f"{found}.weight") >= limit, "block").otherwise("allow")
    return out.select("*", F.col(f"{found}.strict").alias("strict_hits"), F.col(f"{found}.soft").alias("soft_hits"), F.col(f"{found}.weight").alias("weight"), F.coalesce(by_rule, by_terms).alias("verdict")).drop(by_rule, found)


def _sql() -> str:
    edge = "[^a-z0-9]"
    cases = "\n".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}|{h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    terms = [(t, w) for t, w in VOCABULARY.items() if w < LIMIT]
    strict = "|".join(t for t, w in VOCABULARY.items() if w >= LIMIT)
    soft = " + ".join(f"{w} * CAST(regexp_matches(u, '(^|{edge}){t}({edge}|$)') AS INT)" for t, w in terms)
    return f"""
    WITH a AS (SELECT page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS u,
                      CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
    b AS (SELECT page_id, u, translate(regexp_extract(after, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    c AS (SELECT *, CASE {cases} END AS fit,
                 regexp_matches(u, '(^|{edge})({strict})({edge}|$)') OR {soft} >= {LIMIT} AS bad FROM b)
    SELECT page_id, host, path, CASE WHEN fit IS NULL THEN NULL ELSE split_part(fit, '|', 2) END AS rule,
           CASE WHEN fit IS NOT NULL THEN split_part(fit, '|', 1) WHEN bad THEN 'block' ELSE 'allow' END AS verdict FROM c"""


SQL = _sql()


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every row of pages."""
    from docforge.llm.common import table

    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
