"""Spelling variants: words of a corpus that differ by one edit, grouped by their commonest form.

Every word of the vocabulary is cut into its padded, positional 3-grams. One
edit destroys three of the longer word's grams at most, so two words within one
edit share at least as many grams as the longer has letters less one, at
positions that differ by no more than their lengths do. Two consequences make
the index distributed:

* Grams have one order, rare ones first. Of two near words' grams only a few are
  not shared, so each has a shared gram among its first four. The index is dealt
  out by these: a group holds the words of one length that have one of their
  first four grams at one place.
* Within a group, the words' grams and positions form an inverted index. Each
  query word (the group's own, and those of one letter less) merges the
  postings of its grams by a heap. Since all grams but a few must be shared, the
  few shortest lists and one more hold every candidate; longer ones are only
  counted against. Words that reach the bound are verified.

A group of many words is split into blocks by a hash of the word; its words
also query the blocks after their own, and other query words all blocks, so
nothing is left out and a task holds one block. Rarity comes from counts of gram hashes, a table of fixed size.

A word's form is its near word of the largest count, the first of these in
code-point order, if that has at least ``RATIO`` times its own; the root follows
forms to the last. Counts at least double from form to form, so a chain has
under 63 links and six doublings of the links find every root.

Defined results: a null text has no words, a null doc_id counts as an empty one;
repeated rows count again; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm import common

#: The contract's words: letters of two ranges, a length and a count from which a run is a word.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: How much commoner than a word its form must be.
RATIO = 2
Q = 3
#: Grams of a word that go into the index: G - T + 1 of G grams, if T are shared.
FIRST = Q + 1
#: Words of one block of a group, about.
BLOCK = 2000
#: Entries of the table of gram counts.
GRAM_BUCKETS = 1 << 16
#: Rows of split groups that are broadcast at most, of under 64 bytes each; beyond that they are merge-joined.
MOST_BROADCAST = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = "gram string, length int, place int, query boolean, word string, n bigint"


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of all words of at least ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences.

    Letters A-Z are lower-cased. A run whose crc32 with its document is divisible
    by 97 loses one letter: the query's contract plants misspellings in this way.
    """
    given = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    lowered = F.translate(common.text_or_empty(), _UPPER, _LOWER)
    runs = docs.select(given.alias("doc"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LENGTH)
    hashed = runs.withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "utf-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def grams(word: str) -> list[str]:
    padded = "\0" * (Q - 1) + word + "\0" * (Q - 1)
    return [padded[i : i + Q] for i in range(len(word) + Q - 1)]


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % GRAM_BUCKETS


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``a`` ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _gram_counts(words: DataFrame) -> np.ndarray:
    """How many grams of the vocabulary fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(GRAM_BUCKETS, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for gram in grams(word):
                    found[bucket(gram)] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["bucket", "n"])

    rows = words.select("word").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(GRAM_BUCKETS, np.int64)
    for r in rows:
        counts[r.bucket] = r.n
    return counts


def _index_rows(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """Each word at the groups of its first grams, and as a query of those of one letter more."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.string()), ("length", pa.int32()), ("place", pa.int32()), ("query", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])
        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, size = grams(word), len(word)
                for at in sorted(range(len(own)), key=lambda i: (counts[bucket(own[i])], own[i], i))[:FIRST]:
                    gram = own[at]
                    rows.append((gram, size, at, False, word, n))
                    # The longer word's gram is at the same place or one further.
                    rows += [(gram, s, p, True, word, n) for s, p in ((size + 1, at), (size + 1, at + 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else schema.empty_table().to_batches()[0]

    return words.select("word", "n").mapInArrow(place, _ROW)


class _Block:
    """Words of one length with their positional inverted index.

    A word that shares all of a query's grams but ``missing`` is in one of any
    ``missing`` + 1 of their postings lists, so only the shortest ones are
    merged; a query of which more grams have no list at all has no near word
    here. The number of shared grams decides who is compared.
    """

    def __init__(self, size: int, rows: list[tuple[str, int]]):
        self.size, self.rows = size, rows
        self.least = size + Q - 1 - Q
        self.own = [list(enumerate(grams(word))) for word, _ in rows]
        self.places = list(map(set, self.own))
        self.postings: dict[tuple[int, str], list[int]] = {}
        for i, own in enumerate(self.own):
            for at in own:
                self.postings.setdefault(at, []).append(i)

    def _compared(self, word: str, lists: list[list[int]], wanted: set[tuple[int, str]], after: int = -1) -> Iterator[tuple[str, int]]:
        last = after
        for i in heapq.merge(*lists) if len(lists) > 1 else chain(*lists):
            if i > last:
                last = i
                if len(wanted & self.places[i]) >= self.least and one_edit(word, self.rows[i][0]):
                    yield self.rows[i]

    def within(self) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
        """Pairs of the block's own words."""
        for i, own in enumerate(self.own):
            lists = [self.postings[at] for at in own]
            if sum(len(found) == 1 for found in lists) <= Q:  # lists of this word alone tell nothing
                lists.sort(key=len)
                for other in self._compared(self.rows[i][0], lists[: Q + 1], self.places[i], i):
                    yield self.rows[i], other

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words of the block within one edit of a word of its length, or of one letter less."""
        get, own = self.postings.get, list(enumerate(grams(word)))
        missing = len(own) - self.least
        if len(word) == self.size:
            lists, wanted = [found for at in own if (found := get(at))], own
        else:  # the other word's gram is at the same place or one further
            shifted = [(at + 1, g) for at, g in own]
            lists, wanted = [], own + shifted
            for at, further in zip(own, shifted, strict=True):
                here, there = get(at), get(further)
                if here or there:
                    lists.append(sorted(here + there) if here and there else here or there)
        absent = len(own) - len(lists)
        if absent <= missing:
            lists.sort(key=len)
            yield from self._compared(word, lists[: missing + 1 - absent], set(wanted))


def _pairs(rows: DataFrame) -> DataFrame:
    """word, near, n, near_n for each pair of near words, the shorter or lesser first; pairs that share several grams come several times."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, block = None, [], None

        def found(pairs: Iterator[tuple[tuple[str, int], tuple[str, int]]], out: list[tuple[str, str, int, int]]) -> None:
            for (word, n), (other, m) in pairs:
                out.append((word, other, n, m) if (len(word), word) < (len(other), other) else (other, word, m, n))

        def ended(out: list[tuple[str, str, int, int]]) -> None:
            if len(words) > 1:
                found((block or _Block(key[1], words)).within(), out)

        def batch_of(out: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "near", "n", "near_n"])

        for batch in batches:
            out: list[tuple[str, str, int, int]] = []
            for gram, size, place, salt, query, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (gram, size, place, salt) != key:
                    ended(out)
                    key, words, block = (gram, size, place, salt), [], None
                if not query:
                    words.append((word, n))
                elif words:
                    block = block or _Block(size, words)
                    found((((word, n), other) for other in block.near(word)), out)
            yield batch_of(out)
        out = []
        ended(out)
        yield batch_of(out)

    keys = ["gram", "length", "place", "salt"]
    sorted_rows = rows.select(*keys, "query", "word", "n").repartition(*keys).sortWithinPartitions(*keys, "query")
    return sorted_rows.mapInArrow(search, "word string, near string, n bigint, near_n bigint")


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """With ``salt``, the block of a group: a word of the index is in one, and a query of those after it; other queries go to all."""
    keys = ["gram", "length", "place"]
    large = rows.where(~F.col("query")).groupBy(*keys).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > block)
    large = common.materialize(large.select(*keys, F.ceil(F.col("held") / block).cast("int").alias("parts")), "large-gram-groups")
    few = large.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    joined = rows.join(F.broadcast(large) if few else large.hint("merge"), keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    first = F.when(F.col("query"), 0).otherwise(own)
    salted = joined.withColumn("own", own).withColumn("salt", F.explode(F.sequence(first, F.col("parts") - 1)))
    return salted.withColumn("query", F.col("query") | (F.col("salt") > F.col("own")))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near, n, near_n for each pair of words (``word``, ``n``) that differ by exactly one edit, both ways round."""
    rows = common.materialize(_index_rows(words, _gram_counts(words)), "gram-rows")
    pairs = _pairs(_in_blocks(rows, block)).distinct()
    both = F.array(
        F.struct("word", "near", "n", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("near_n").alias("n"), F.col("n").alias("near_n")),
    )
    return pairs.select(F.inline(both))


def roots(links: DataFrame) -> DataFrame:
    """word, root for each row word, form of ``links``; a form that is no row's word is a root.

    Links double until none changes; each round's table is written, and joined with itself.
    """
    now = common.materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        doubled = common.materialize(doubled, "roots")
        now = doubled.select("word", "root")
        if doubled.where("moved").isEmpty():
            return now


def variants(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word (``word``, ``n``)."""
    words = common.materialize(words, "vocabulary")
    best = near_words(words, block).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "best")
    close = -F.col("best.less") >= RATIO * F.col("n")
    found = found.select("word", "n", "n_near", F.when(close, F.col("best.near")).alias("form"), F.when(close, -F.col("best.less")).alias("form_n"))
    found = common.materialize(found, "word-forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 by its polynomial, a byte at a time, over a table that eight shifts of each byte make.
ORACLE = rf"""
    with recursive crc_table as (
      select list(v order by b) as steps from (
        select b, list_reduce(list_prepend(b, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
        from (select unnest(range(256)) as b))),
    runs as (
      select coalesce(cast(doc_id as varchar), '') as doc, run, count(*) as times from (
        select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as run
        from documents) where length(run) >= {LEAST_LENGTH} group by all),
    hashed as (
      select run, times, xor(list_reduce(
          list_prepend(4294967295, list_transform(range(octet_length(encode(doc || ':' || run))),
            lambda i: cast(('0x' || substr(hex(encode(doc || ':' || run)), 2 * i + 1, 2)) as bigint))),
          lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) as h
      from runs, crc_table),
    words as (
      select word, sum(times)::bigint as n from (
        select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from hashed)
      where length(word) >= {LEAST_LENGTH} group by 1 having sum(times) >= {LEAST_COUNT}),
    shorter as (
      select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest
      from (select word, n, unnest(range(length(word))) as i from words)),
    near as (
      select a.word, b.word as near, b.n as near_n from shorter a join shorter b on a.rest = b.rest and a.i = b.i and a.word <> b.word
      union select a.word, b.word, b.n from shorter a join words b on a.rest = b.word
      union select b.word, a.word, a.n from shorter a join words b on a.rest = b.word),
    best as (select word, count(*) as n_near, max(near_n) as most from near group by 1),
    named as (select word, n_near, most, min(near) as near from near join best using (word) where near_n = most group by all),
    forms as (
      select word, n, coalesce(n_near, 0) as n_near, case when most >= {RATIO} * n then near end as form, case when most >= {RATIO} * n then most end as form_n
      from words left join named using (word)),
    chain as (
      select word, word as root, 0 as steps from forms
      union all select c.word, f.form, c.steps + 1 from chain c join forms f on f.word = c.root where f.form is not null),
    ends as (select word, arg_max(root, steps) as root from chain group by 1)
    select word, form, root, n, n_near, form_n from forms join ends using (word)"""
