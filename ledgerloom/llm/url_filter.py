"""URL filter: allow and block rules by host and path, else a weighted vocabulary counted with Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

#: (term, kind, weight): the vocabulary of the query, an example; others come as a table. A strict term rejects a URL, different
#: soft terms do so together from SOFT_LIMIT on.
TERMS = (
    *((t, "strict", 1.0) for t in ("porn", "xxx", "casino", "viagra", "warez", "malware", "phishing", "escort", "torrent")),
    *((t, "soft", 1.0) for t in ("win", "prize", "cheap", "pills", "spam", "farm", "bet", "loan", "crack", "adult", "bonus")),
    *((t, "soft", 0.5) for t in ("free", "click", "download", "deal", "best", "online", "offer")),
)
SOFT_LIMIT = 2.0
#: Different soft terms that it takes at least.
SEVERAL = 2
#: Rules of the query: host and path in one string, verdict.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased and path; both empty without ``://``."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def longest_rule(host: str, path: str, rules: dict[str, dict[str, str]]) -> tuple[str | None, str | None]:
    """Of the rules that fit the host or a parent domain and whose path starts ``path``: the longest, its verdict."""
    best: tuple[str, str] | None = None
    labels = host
    while labels:
        for prefix, verdict in rules.get(labels, {}).items():
            if path.startswith(prefix) and (best is None or len(labels + prefix) > len(best[0])):
                best = (labels + prefix, verdict)
        labels = labels.partition(".")[2]
    return best or (None, None)


def vocabulary(terms: list[tuple[str, str, float]]) -> ahocorasick.Automaton:
    """Of the rows of a term strict goes before soft and the larger weight before the smaller."""
    words = ahocorasick.Automaton()
    for term, kind, weight in sorted(terms, key=lambda t: (t[1] == "strict", t[2])):
        words.add_word(term.lower(), (kind, term.lower(), weight))
    words.make_automaton()
    return words


def _part_of_word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def term_hits(url: str, words: ahocorasick.Automaton) -> tuple[int, int, float]:
    """Different strict terms, different soft terms and the weight of these, that stand in the lower-cased URL with no ASCII
    letter or digit on either side."""
    url = url.lower()
    hits = {}
    for end, (kind, term, weight) in words.iter(url):
        start = end - len(term)
        if (start < 0 or not _part_of_word(url[start])) and (end + 1 == len(url) or not _part_of_word(url[end + 1])):
            hits[term] = kind, weight
    soft = [w for kind, w in hits.values() if kind != "strict"]
    return len(hits) - len(soft), len(soft), float(sum(soft))


def judge_urls(pages: DataFrame, rules: tuple = RULES, terms: tuple | DataFrame = TERMS, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight for each row of ``pages`` (page_id, url).

    ``terms`` (term, kind, weight): the vocabulary, as rows or as a table, which is collected: it has to fit in a task's
    memory as the automaton does. Without a fitting rule a strict term blocks, and so do SEVERAL different soft terms, or more, whose
    weights make up ``soft_limit``; a single soft term never does, whatever its weight. Null or empty url: host and path empty, allowed. Repeated rows are kept, null ids stay null,
    other columns are ignored, no rows give none. A URL is judged alone, so there is no shuffle."""
    by_host: dict[str, dict[str, str]] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        by_host.setdefault(host.lower(), {})[slash + path] = verdict
    if isinstance(terms, DataFrame):
        terms = [tuple(r) for r in terms.where("term <> '' and kind in ('strict', 'soft')").select("term", "kind", F.coalesce(F.col("weight").cast("double"), F.lit(1.0))).collect()]
    listed = [t for t in terms if t[0]]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(listed)
        for batch in batches:
            out = []
            for url in batch["url"]:
                host, path = split_url(url)
                rule, verdict = longest_rule(host, path, by_host)
                n_strict, n_soft, weight = term_hits(url or "", words) if listed else (0, 0, 0.0)
                out.append((host, path, rule, verdict or ("block" if n_strict or n_soft >= SEVERAL and weight >= soft_limit else "allow"), n_strict, n_soft, weight))
            made = pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"])
            made.insert(0, "page_id", batch["page_id"].to_numpy())
            yield made

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInPandas(judge, "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long, soft_weight double")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


_RULES = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in RULES)
ORACLE = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, lower(regexp_extract(rest, '^[^/?#]*')) AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rules(rh, rp, rule, v) AS (VALUES {_RULES}),
fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM parts, rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
terms(t, kind, w) AS (VALUES {", ".join(f"('{t}', '{k}', {w}::DOUBLE)" for t, k, w in TERMS)}),
hits AS (
  SELECT p.page_id, count(*) FILTER (kind = 'strict') AS n_strict, count(*) FILTER (kind = 'soft') AS n_soft, coalesce(sum(w) FILTER (kind = 'soft'), 0) AS weight
  FROM parts p LEFT JOIN terms ON regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9])' || t || '($|[^a-z0-9])') GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, CASE WHEN n_strict > 0 OR n_soft >= {SEVERAL} AND weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n_strict AS BIGINT) AS n_strict, CAST(n_soft AS BIGINT) AS n_soft, CAST(weight AS DOUBLE) AS soft_weight
FROM parts p LEFT JOIN fit f USING (page_id) JOIN hits h USING (page_id)
"""
