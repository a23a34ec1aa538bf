"""URL filter: host and path rules over a weighted vocabulary.

An Aho-Corasick automaton finds every vocabulary term in a lower-cased URL in
one pass. A hit counts only between boundaries (no ASCII letter or digit
before or after it). Each distinct term that is found adds its weight, and a sum
of 1 blocks the URL: one strict term weighs so much, a soft one a share of it.
Explicit rules win over the vocabulary; of the rules that fit, the longest wins.
The vocabulary is a parameter, and may be a table (``load_vocabulary``).

Defined results: a null URL, and one without ``://``, has an empty host and
path; a null URL has no hits and is allowed. Upper-case ASCII letters of the
host are lowered, other characters stay. An empty table gives an empty result;
extra columns are ignored and repeated rows are judged one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, start of path)
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Terms that block alone, and terms of which two distinct ones do, in English, German, French and Spanish.
STRICT = (
    "adult", "bets", "casino", "casinos", "escort", "hentai", "kasino", "pills", "porn", "porno", "sexshop", "spam", "viagra", "warez", "xxx",
)
SOFT = (
    "ads", "apuestas", "barato", "bet", "bonus", "cheap", "click", "crypto", "dating", "deal", "farm", "free", "gratis", "gratuit", "kostenlos",
    "kredit", "loan", "pari", "rabatt", "sex", "sorteo", "track", "wetten", "win",
)
SOFT_WEIGHT = 0.5
Vocabulary = Sequence[tuple[str, float]]
VOCABULARY: Vocabulary = (*((t, 1.0) for t in STRICT), *((t, SOFT_WEIGHT) for t in SOFT))
#: Terms of a vocabulary at most; every task builds the automaton (about 100 bytes a character).
MOST_TERMS = 1_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def load_vocabulary(terms: DataFrame) -> Vocabulary:
    """The vocabulary of a table (term, weight): lowered, without empty terms; of a repeated term the largest weight counts.

    A null weight is a soft term's.
    """
    term = F.translate("term", _UPPER, _UPPER.lower()).alias("term")
    weight = F.max(F.coalesce(F.col("weight").cast("double"), F.lit(SOFT_WEIGHT))).alias("weight")
    found = terms.where(F.length("term") > 0).groupBy(term).agg(weight).limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"a vocabulary has at most {MOST_TERMS} terms")
    return sorted((r.term, r.weight) for r in found)


def _counter(vocabulary: Vocabulary):
    """Counts of distinct strict and soft terms with boundaries, and the sum of their weights, a batch of URLs at a time."""

    def count(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        weights = dict(vocabulary)
        for term in weights:
            automaton.add_word(term, term)
        automaton.make_automaton()
        plain = str.maketrans(_UPPER, _UPPER.lower())
        word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in urls:
            rows = []
            for url in batch:
                hits: set[str] = set()
                if url is not None and weights:
                    url = url.translate(plain)
                    for end, term in automaton.iter(url):
                        begin = end - len(term) + 1
                        if (begin == 0 or url[begin - 1] not in word) and (end + 1 == len(url) or url[end + 1] not in word):
                            hits.add(term)
                n = sum(weights[t] >= 1 for t in hits)
                rows.append((n, len(hits) - n, math.fsum(weights[t] for t in hits)))
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_hits", "weight"])

    return F.pandas_udf(count, "strict_hits int, soft_hits int, weight double")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits, weight for every row of ``pages``.

    There is no shuffle: the automaton is built once in each task, and one task
    holds a batch of URLs at most.
    """
    host, path = host_and_path(F.col("url"))
    found = pages.select(
        "page_id", host.alias("host"), path.alias("path"),
        matching_rule(host, path, rules).alias("ruled"), _counter(vocabulary)("url").alias("hits"),
    )
    own = F.when(F.col("hits.weight") >= 1, "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"),
        F.coalesce(F.col("ruled.verdict"), own).alias("verdict"), "hits.strict_hits", "hits.soft_hits", "hits.weight",
    )


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: Vocabulary = VOCABULARY) -> str:
    """The same in DuckDB SQL: a regular expression for each term."""

    def has(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::int"

    strict, soft = [t for t, w in vocabulary if w >= 1], [t for t, w in vocabulary if w < 1]
    weight = " + ".join(f"{has(t)} * {w}::double" for t, w in vocabulary)
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = [(v, d + p, f"((host = '{d}' or suffix(host, '.{d}')) and starts_with(path, '{p}'))") for v, d, p in ranked]
    rule = " ".join(f"when {c} then '{r}'" for _, r, c in fits)
    verdict = " ".join(f"when {c} then '{v}'" for v, _, c in fits)
    return f"""
    with u as (
      select page_id, url, translate(coalesce(url, ''), '{_UPPER}', '{_UPPER.lower()}') as low,
             case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
      from pages),
    s as (
      select page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
      from u),
    h as (
      select *, ({" + ".join(map(has, strict))})::int as strict_hits,
             ({" + ".join(map(has, soft))})::int as soft_hits, {weight} as weight
      from s)
    select page_id, host, path, case {rule} end as rule,
           case {verdict} when weight >= 1 then 'block' else 'allow' end as verdict,
           strict_hits, soft_hits, weight
    from h"""
