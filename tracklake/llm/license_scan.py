"""Licence scan by canonical digests.

A text is brought into a canonical form (ASCII case, copyright lines,
punctuation and white space, equivalent spellings), hashed, and the hash joined
to the digests of known licence texts. The same lookup is made for every line,
which finds one-line notices inside longer documents; the form of a text is put
together from those of its lines. All of it is built-in expressions in one pass;
the table of known digests is fixed and small, so it is
broadcast and documents are never shuffled.

Defined results: a null text counts as empty and, like any text without letters
or digits, matches nothing; repeated rows are scanned one by one; an empty table
gives an empty result; extra columns are ignored. Texts have no length limit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.llm import common
from tracklake.llm.license_texts import FULL_TEXTS, LICENSES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _any_case(words: str) -> str:
    """A pattern for ASCII words in either case; the flag of some languages folds other letters too."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


_NAME = r"[A-ZÀ-ÖØ-Þ][^ \t\n]*"
_BETWEEN = r"(?:and|the|of|for|in|de|del|der|den|di|la|van|von|et|al|others|contributors|authors|&|<[^ \t\n]*)[.,]?"
#: Lines that name a holder, not a licence: a copyright sign; the word with a year or a place for one; or, unless it is all in
#: capitals, the word with nothing but two or more (at most 41) capitalised words. Other lines of the licence itself that start
#: with "copyright" stay, so the form hardly depends on where lines break. Applied before case is removed.
COPYRIGHT_LINE = (
    r"(?m)^[ \t*#/;%-]*(?:" + _any_case("portions") + r"[ \t]+)?(?:"
    r"(?:" + _any_case("copyright") + r"[ \t]*)?(?:\([cC]\)|©)[^\n]*|"
    + _any_case("copyright") + r"[^\n]*?(?:[12][0-9]{3}|[\[<{](?:" + "|".join(map(_any_case, ("yyyy", "year", "name", "copyright"))) + r"))[^\n]*|"
    r"[Cc]opyright[ \t]+(?:by[ \t]+)?(?:[Tt]he[ \t]+)?" + _NAME + r"(?:[ \t]+(?:" + _NAME + "|" + _BETWEEN + r")){1,40}[ \t]*|"
    + _any_case("all rights reserved") + r"[ \t.]*)$"
)
#: Runs of anything but letters and digits among ASCII, and typographic marks.
MARKS = r"[\x01-\x2f\x3a-\x60\x7b-\x7f“”‘’‚„«»–—…·•©®™ ]+"
#: Equivalent spellings, applied in this order.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"),
    ("recognise", "recognize"), ("authoris", "authoriz"), ("behaviour", "behavior"), ("whilst", "while"), ("per cent", "percent"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("sub license", "sublicense"), ("third party", "thirdparty"),
    ("third parties", "thirdparties"), ("copyright owner", "copyright holder"), ("https", "http"),
)


def _respelled(text: Column, spellings: Sequence[tuple[str, str]]) -> Column:
    for a, b in spellings:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def canonical(text: Column) -> Column:
    # Line feeds alone end lines, as in the other languages that use the pattern.
    out = F.regexp_replace(text, COPYRIGHT_LINE.replace("(?m)", "(?md)"), "")
    out = F.translate(out, _UPPER, _UPPER.lower())
    return _respelled(F.trim(F.regexp_replace(out, MARKS, " ")), SPELLINGS)


def canonical_of_lines(lines: Column) -> Column:
    """The canonical form of a text from those of its lines; only spellings of two words can lie across a line break."""
    whole = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    return _respelled(whole, [(a, b) for a, b in SPELLINGS if " " in a])


def canonical_text(text: str) -> str:
    """The same in Python, for the known texts."""
    out = re.sub(COPYRIGHT_LINE, "", text)
    out = out.translate(str.maketrans(_UPPER, _UPPER.lower()))
    out = re.sub(MARKS, " ", out).strip(" ")
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out


def known_texts(text: str) -> list[str]:
    """Canonical forms of a known text: in lines, without the holder lines, and in one line, where those can't be told from the rest."""
    return [canonical_text(text), canonical_text(" ".join(text.split()))]


def known_digests(licenses: Sequence[tuple[str, str]] = LICENSES) -> dict[str, str]:
    """Licence by digest; the first text of equal ones counts."""
    out: dict[str, str] = {}
    for name, text in licenses:
        for plain in filter(None, known_texts(text)):
            out.setdefault(hashlib.sha256(plain.encode()).hexdigest(), name)
    for name, _, digest in FULL_TEXTS:
        out.setdefault(digest, name)
    return out


def scan(docs: DataFrame, licenses: Sequence[tuple[str, str]] = LICENSES) -> DataFrame:
    """doc_id, digest, license (of the whole text, or null), notices (licences of single lines, sorted, with commas)."""
    known = known_digests(licenses)
    schema = T.StructType().add("digest", T.StringType()).add("license", T.StringType())
    table = docs.sparkSession.createDataFrame(list(known.items()), schema)
    longest = max((len(plain) for _, text in licenses for plain in known_texts(text)), default=0)
    longest = max(longest, *(n for _, n, _ in FULL_TEXTS))
    # A line whose canonical form is longer than every known one can't be one; the others are hashed.
    short = F.filter("lines", lambda x: F.length(x).between(1, longest))
    digests = F.transform(short, lambda x: F.sha2(x, 256))
    names = F.create_map(*(F.lit(v) for pair in known.items() for v in pair))
    found = F.array_sort(F.array_distinct(F.transform(F.array_intersect(digests, F.array(*map(F.lit, known))), lambda d: names[d])))
    shown = docs.select("doc_id", F.transform(F.split(common.text_or_empty(), "\n"), canonical).alias("lines"))
    hashed = shown.select("doc_id", F.sha2(canonical_of_lines(F.col("lines")), 256).alias("digest"), F.array_join(found, ",").alias("notices"))
    return hashed.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license", "notices")


def oracle(licenses: Sequence[tuple[str, str]] = LICENSES) -> str:
    def canon(x: str) -> str:
        out = f"translate(regexp_replace({x}, '{COPYRIGHT_LINE}', '', 'g'), '{_UPPER}', '{_UPPER.lower()}')"
        out = f"trim(regexp_replace({out}, '{MARKS}', ' ', 'g'), ' ')"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return f"sha256({out})"

    values = ", ".join(f"('{d}', '{n}')" for d, n in known_digests(licenses).items())
    return f"""
    with known(digest, license) as (values {values}),
    d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
    l as (select r, unnest(string_split(text, chr(10))) as line from d),
    n as (
      select r, string_agg(distinct license, ',' order by license) as notices
      from (select r, {canon("line")} as digest from l) join known using (digest)
      group by r),
    w as (select r, doc_id, {canon("text")} as digest from d)
    select doc_id, digest, license, coalesce(notices, '') as notices
    from w left join n using (r) left join known using (digest)"""
