"""Fuzzy line deduplication with DataFrame operations only.

Lines are normalised (case, punctuation, white space) and hashed. The SimHash
of a line has one bit for each of 64 majority votes of its distinct words'
hashes (each once, or common words alone would decide long lines); several votes
are counted in one 64-bit sum, and the votes of a few words are added before they
are grouped. Two lines are near if

* their SimHashes agree on at least ``agree`` of ``blocks`` blocks and differ in
  at most ``bits`` bits (``Rule``), and
* their edit distance is at most a fifth of the longer one's length.

By the pigeonhole principle every pair that differs in at most ``blocks - agree``
bits agrees on enough blocks, so an equi-join on every choice of ``agree``
blocks finds all near lines. Of each connected group of near lines the first
occurrence (smallest doc_id, then position) stays.

Groups are found in two passes. The first compares each line with the first one
that begins or ends with the same characters, or has a quarter of its SimHash, which joins
most of a large group in as many comparisons as it has lines. The second compares
lines that are still in different groups: of each bucket, all lines that are
outside its largest group, with all lines of the bucket. So a bucket full of one
group costs no pairs, and no connection is lost. A pair of lines comes from the
first of its common buckets only.

``by_edits`` looks for candidates by other keys than SimHash blocks: the 8
smallest hashes of a line's word triples, with its length class, lines of few
words less each word, and short lines less each character. It finds lines with
more and smaller edits, at several times the cost.

Defined results: a row of the input is a document, whatever its doc_id; a null
or empty text is one empty line; lines without a letter or digit always stay and
take no part; of rows that repeat a doc_id the one of the smaller text hash comes
first, and a null doc_id comes last. Line numbers count from 0. Extra columns
are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.llm import common
from tracklake.llm.components import connected_components

MOST_BITS = 3
SIMILARITY = 0.8
#: Word triples that a line is looked up by, and bits in which the SimHashes of lines with a common one differ at most.
TRIPLES, TRIPLE_BITS = 8, 22
#: Lines of at most so many words or characters are also looked up by what is left without one of them.
FEW_WORDS, FEW_CHARACTERS = 12, 24
#: Distinct words that the fields of a vote hold, seven fields and three in a sum; lines that may have more are counted bit by bit.
FEW_VOTES, MOST_WORDS = 2**8 - 1, 2**20 - 1
#: Lines of groups of at most so many are compared with all of a bucket, also with lines of their own group.
SMALL_GROUP = 32
#: Characters of the pieces whose edit distances add up to an upper bound, and of the texts by which pieces are aligned.
PIECE, ANCHOR = 32, 24
#: Characters at a line's start and at its end that lines of one leader share.
END = 24
#: Words whose votes are added before they are grouped, for lines of few and of many words.
TOGETHER = {FEW_VOTES: 8, MOST_WORDS: 4}
_LAST = 2**63 - 1
#: Both sides of a pair, as (id, SimHash, length) columns, to a condition.
Near = Callable[[Column, Column, Column, Column, Column], Column]


@dataclass(frozen=True)
class Rule:
    """When two SimHashes are close: they agree on ``agree`` of ``blocks`` blocks and differ in at most ``bits`` bits."""

    bits: int = MOST_BITS
    blocks: int = MOST_BITS + 1
    agree: int = 1

    def close(self, a: Column, b: Column) -> Column:
        differs = a.bitwiseXOR(b)
        out = F.bit_count(differs) <= self.bits
        if self.blocks - self.agree < self.bits:  # else the bits alone imply it
            same = [(differs.bitwiseAND(F.lit(mask)) == 0).cast("int") for mask in _masks(self.blocks)]
            out &= sum(same[1:], same[0]) >= self.agree
        return out

    def first(self, key: Column, a: Column, b: Column) -> Column:
        """Whether no key before ``key`` is common to two SimHashes that have it in common; hashed keys don't tell, and all are first."""
        width = _width(self.blocks)
        if width * self.agree > 40:
            return F.lit(True)
        choices = list(combinations(range(self.blocks), self.agree))
        n = F.shiftrightunsigned(key, width * self.agree).cast("int")
        masks = _masks(self.blocks)
        same = [F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(mask)) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, mask in enumerate(masks)]
        # The first key is made of the first blocks that agree: no other one up to its last.
        until = F.array(*(F.lit((2 << choice[-1]) - 1) for choice in choices))[n]
        own = F.array(*(F.lit(sum(1 << i for i in choice)) for choice in choices))[n]
        return sum(same[1:], same[0]).bitwiseAND(until) == own


#: What the query uses: all pairs within 5 bits, and those within 10 that agree on 18 bits or more.
WIDE = Rule(bits=10, blocks=7, agree=2)


#: The characters of [\\p{Punct}\\s], one by one: Java looks those up in a table.
_GAPS = "".join(f"\\{c}" for c in string.punctuation) + r" \t\n\x0B\f\r"


def normalized(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), f"[{_GAPS}]+", " "))


def _lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_key, pos, norm, length, k1, k2, head, tail of every line.

    ``k1`` and ``k2`` name the normalised line, ``row`` the document; ``head`` and ``tail`` are hashes of the line's ends.
    """
    text = common.text_or_empty()
    # The id is given before lines are split, so all lines of a document have the same.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select("row", "doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = rows.select("row", "doc_id", "text_key", "pos", normalized(F.col("line")).alias("norm"))
    ends = {"head": F.xxhash64(F.left("norm", F.lit(END))), "tail": F.xxhash64(F.lit(7), F.right("norm", F.lit(END)))}
    return lines.withColumns({"length": F.length("norm"), **_names(F.col("norm")), **ends})


def _names(norm: Column) -> dict[str, Column]:
    return {"k1": F.xxhash64(norm), "k2": F.xxhash64(F.lit(7), norm)}


def _order() -> Column:
    """One number that orders occurrences by doc_id, document and position."""
    first = F.coalesce("doc_id", F.lit(_LAST)).cast("decimal(20,0)") * F.lit(2**62).cast("decimal(19,0)")
    return (first.cast("decimal(38,0)") + (F.shiftleft(F.col("text_key").bitwiseAND(F.lit(2**31 - 1)), 31) + F.col("pos")).cast("decimal(20,0)")).cast("decimal(38,0)")


#: What names a line and goes with its SimHash.
_KEYS = ["row", "doc_id", "text_key", "pos", "k1", "k2", "head", "tail", "length"]


def _words() -> Column:
    return F.array_distinct(F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)))


def _simhashes(lines: DataFrame) -> DataFrame:
    """row, doc_id, text_key, pos, k1, k2, head, tail, length, sim of every line with a word."""
    lines, keys = lines.where("length > 0"), _KEYS
    spaces = F.col("length") - F.length(F.replace("norm", F.lit(" "), F.lit("")))
    # A line has at most half as many words as characters, and one; so the spaces of most lines needn't be counted.
    short = F.col("length") < 2 * FEW_VOTES
    few, more = short | (spaces < FEW_VOTES), ~short & (spaces >= FEW_VOTES) & (F.col("length") < 2 * MOST_WORDS)
    return _majorities(lines.where(few), keys, FEW_VOTES).union(_majorities(lines.where(more), keys, MOST_WORDS))


def _majorities(lines: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``keys`` and sim of lines of at most ``most`` distinct words, one less than a power of two."""
    width, together = most.bit_length() + 1, TOGETHER[most]
    # Zeros after the words, which vote for nothing, fill the last step.
    words = lines.select(*keys, F.concat(_words(), F.array(*[F.lit(0).cast("bigint")] * (together - 1))).alias("words"))
    words = words.select(*keys, "words", F.explode(F.sequence(F.lit(0), F.size("words") - together, F.lit(together))).alias("at"))
    h = [F.col("words")[F.col("at") + j] for j in range(together)]
    # Bits i, i + width and so on of the hashes are counted in the fields of one sum; 63 is a multiple of the width.
    ones = sum(1 << at for at in range(0, 63, width))

    def added(votes: Callable[[Column], Column], name: str) -> Column:
        return F.sum(sum((votes(x) for x in h[1:]), votes(h[0]))).alias(name)

    votes = [added(lambda x, i=i: F.shiftrightunsigned(x, i).bitwiseAND(F.lit(ones)), f"v{i}") for i in range(width)]
    votes.append(added(lambda x: F.shiftrightunsigned(x, 63), "last"))
    sums = words.groupBy(*keys).agg(F.max(F.size("words") - (together - 1)).alias("n"), *votes)
    # A field with 2 * votes + (most - n) has its highest bit set if more than half of the words voted.
    half = (F.lit(most) - F.col("n")) * F.lit(ones)
    sim = F.when(F.col("last") * 2 > F.col("n"), F.lit(-(2**63))).otherwise(F.lit(0)).cast("bigint")
    for i in range(width):
        won = F.shiftrightunsigned(F.col(f"v{i}") * 2 + half, width - 1).bitwiseAND(F.lit(ones))
        sim = sim.bitwiseOR(F.shiftleft(won, i))
    return sums.select(*keys, sim.alias("sim"))


def _long_simhashes(lines: DataFrame) -> DataFrame:
    """The same for lines of any number of words, by one sum for each line and bit."""
    keys = _KEYS
    words = lines.select(*keys, F.explode(_words()).alias("h"))
    bits = words.select(*keys, "h", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    sums = bits.groupBy(*keys, "bit").agg(F.sum(F.expr("shiftrightunsigned(h, bit) & 1")).alias("votes"), F.count(F.lit(1)).alias("n"))
    won = F.when(F.col("votes") * 2 > F.col("n"), F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("bigint"))
    return sums.groupBy(*keys).agg(F.bit_or(won).alias("sim"))


def _borders(blocks: int) -> list[tuple[int, int]]:
    at = [64 * i // blocks for i in range(blocks + 1)]
    return list(zip(at, at[1:], strict=False))


def _width(blocks: int) -> int:
    return max(hi - lo for lo, hi in _borders(blocks))


def _masks(blocks: int) -> list[int]:
    """The bits of each block, as signed 64-bit numbers."""
    masks = (((1 << (hi - lo)) - 1) << lo for lo, hi in _borders(blocks))
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def _block_keys(sim: Column, blocks: int, agree: int | None = None) -> list[Column]:
    """Keys, one for each choice of ``agree`` (``blocks - MOST_BITS``) blocks of a SimHash.

    A key of few bits is the blocks themselves behind the number of the choice, which takes less room in a shuffle than a hash.
    """
    parts = [F.shiftrightunsigned(sim, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint")) for lo, hi in _borders(blocks)]
    agree = blocks - MOST_BITS if agree is None else agree
    width = _width(blocks)
    keys = []
    for n, choice in enumerate(combinations(range(blocks), agree)):
        key = F.lit(n).cast("bigint")
        for i in choice:
            key = F.shiftleft(key, width).bitwiseOR(parts[i])
        keys.append(key if width * agree <= 40 else F.xxhash64(F.lit(n), *(parts[i] for i in choice)))
    return keys


def block_keys(sim: Column, blocks: int, agree: int | None = None) -> Column:
    """The same as an array."""
    return F.array(*_block_keys(sim, blocks, agree))


def _hosted(lines: DataFrame, rule: Rule) -> DataFrame:
    """The lines once for each block that is the first of some choice, dealt by ``host``, the number and value of that block.

    Lines with a key in common have the host of that key in common, so the keys
    are formed where the lines lie, and only the few hosts of a line are shuffled.
    """
    firsts = range(rule.blocks - rule.agree + 1)
    values = [F.shiftrightunsigned("sim", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint")) for lo, hi in _borders(rule.blocks)]
    hosts = F.array(*(F.shiftleft(F.lit(i).cast("bigint"), 56).bitwiseOR(values[i]) for i in firsts))
    return lines.withColumn("host", F.explode(hosts)).repartition("host")


def _hosted_keys(rule: Rule) -> Column:
    """The keys of a line of ``_hosted`` that belong to its host."""
    choices = list(combinations(range(rule.blocks), rule.agree))
    keys = _block_keys(F.col("sim"), rule.blocks, rule.agree)
    first = F.shiftrightunsigned("host", 56)
    out = F.lit(None)
    for i in range(rule.blocks - rule.agree + 1):
        own = [n for n, choice in enumerate(choices) if choice[0] == i]
        out = F.when(first == i, F.array(*(keys[n] for n in own))).otherwise(out)
    return out


def _allowed(longer: Column) -> Column:
    return F.floor(longer * F.lit(1 - SIMILARITY) + 1e-9).cast("int")


def _fits(a: Column, b: Column) -> Column:
    """Whether lengths allow two lines to be near."""
    return F.abs(a - b) <= _allowed(F.greatest(a, b))


# -- candidates by keys other than SimHash blocks


def _edit_keys(lines: DataFrame) -> DataFrame:
    """k1, k2, keys of every distinct line with a word; lines of few edits share a key."""
    lines = lines.where("length > 0").select("k1", "k2", "norm").dropDuplicates(["k1", "k2"])
    lines = lines.withColumn("words", F.split("norm", " ")).withColumns({"length": F.length("norm"), "size": F.size("words")})
    none = F.array().cast("array<bigint>")
    triple = lambda i: F.xxhash64(F.lit("triple"), F.col("words")[i - 1], F.col("words")[i], F.col("words")[i + 1])
    triples = F.slice(F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("size") - 2), triple))), 1, TRIPLES)
    # Lengths within SIMILARITY of each other are in the same class or in adjacent ones.
    kind = F.floor(F.log(F.col("length").cast("double")) / F.log(F.lit(1 / SIMILARITY)) + 1e-9)
    classed = F.flatten(F.transform("triples", lambda t: F.array(F.xxhash64(t, "kind"), F.xxhash64(t, F.col("kind") + 1))))
    fewer = lambda i: F.xxhash64(F.lit("words"), F.array_join(F.filter("words", lambda _, j: j != i - 1), " "))
    words = F.array_append(F.transform(F.sequence(F.lit(1), F.col("size")), fewer), F.xxhash64(F.lit("words"), "norm"))
    shorter = lambda i: F.xxhash64(F.lit("characters"), F.concat(F.substr("norm", F.lit(1), i - 1), F.substr("norm", i + 1)))
    characters = F.array_append(F.transform(F.sequence(F.lit(1), F.col("length")), shorter), F.xxhash64(F.lit("characters"), "norm"))
    lines = lines.withColumns({
        "triples": F.when(F.col("size") >= 3, triples).otherwise(none),
        "kind": kind,
        "left": F.array_distinct(F.concat(
            F.when(F.col("size").between(2, FEW_WORDS), words).otherwise(none), F.when(F.col("length") <= FEW_CHARACTERS, characters).otherwise(none)
        )),
    })
    # The last bit of a key tells whether SimHashes count.
    keys = F.concat(F.transform(classed, lambda k: k.bitwiseOR(F.lit(1))), F.transform("left", lambda k: k.bitwiseAND(F.lit(-2))))
    return lines.select("k1", "k2", keys.alias("keys"))


# -- groups


def _leader_pairs(keyed: DataFrame, near: Near) -> DataFrame:
    """a, b: each line with the leader of each of its buckets, if they may be near; ``keyed`` has key, id, sim, length.

    A bucket's leader is its line of the smallest id, so a bucket gives no more
    pairs than it has lines.
    """
    leaders = keyed.groupBy("key").agg(
        F.min("id").alias("a"), F.min_by("sim", "id").alias("a_sim"), F.min_by("length", "id").alias("a_length"), F.count(F.lit(1)).alias("n")
    )
    found = keyed.join(leaders.where("n > 1").drop("n").hint("merge"), "key")
    rule = (F.col("id") != F.col("a")) & near(*map(F.col, ("key", "sim", "a_sim", "length", "a_length")))
    return found.where(rule).select("a", F.col("id").alias("b")).distinct()


def _pairs(found: DataFrame) -> DataFrame:
    """a, b, a_grp, b_grp, bits: the lines of a pair, their groups, and in how many bits their SimHashes differ."""
    bits = F.bit_count(F.col("sim").bitwiseXOR(F.col("a_sim")))
    return found.select(F.col("a_id").alias("a"), F.col("id").alias("b"), "a_grp", F.col("grp").alias("b_grp"), bits.alias("bits"))


def _small_crossing_pairs(hosted: DataFrame, by: Rule, near: Near) -> DataFrame:
    """a, b, a_grp, b_grp, bits: lines of one key and different groups that may be near, one of them of a group of at most ``SMALL_GROUP``.

    ``hosted`` has host, id, sim, length, grp, size. Lines of larger groups are on
    one side only, so a bucket costs at most ``SMALL_GROUP`` comparisons a line
    beside those of different groups.
    """
    columns = ["id", "sim", "length", "grp", "size"]
    # An outer explode, and a size in the condition: no filter or column is then taken below one side's exchange only, and both share it.
    keys = _hosted_keys(by)
    a = hosted.select("host", *(F.col(c).alias(f"a_{c}") for c in columns), F.explode_outer(F.when(F.col("size") <= SMALL_GROUP, keys)).alias("key"))
    b = hosted.select("host", *columns, F.explode_outer(keys).alias("key"))
    # The join sorts by key and host, which compares rows and is slow where many keys are equal. A sort by the key alone is by
    # radix, and what it leaves is in the join's order. Spark drops a sort below a join unless something like a row's number follows.
    a = a.sortWithinPartitions("key").withColumn("a_at", F.monotonically_increasing_id())
    b = b.sortWithinPartitions("key").withColumn("at", F.monotonically_increasing_id())
    once = (F.col("size") > SMALL_GROUP) | (F.col("a_id") < F.col("id"))
    rule = once & (F.col("grp") != F.col("a_grp")) & near(*map(F.col, ("key", "sim", "a_sim", "length", "a_length")))
    found = a.join(b.hint("merge"), ["key", "host"]).where(rule & (F.col("a_at") + F.col("at") >= 0))
    return _pairs(found)


def _crossing_pairs(keyed: DataFrame, near: Near) -> DataFrame:
    """a, b, a_grp, b_grp, bits: lines of one bucket and different groups that may be near.

    ``keyed`` has key, id, sim, length, grp, size (of the group). One end is
    always outside the bucket's largest group, so the lines of that group are
    never compared with each other.
    """
    largest = F.first("grp").over(Window.partitionBy("key").orderBy(F.col("size").desc(), "grp"))
    columns = ["id", "sim", "length", "grp", "size"]
    a = keyed.withColumn("top", largest).where(F.col("grp") != F.col("top")).select("key", "top", *(F.col(c).alias(f"a_{c}") for c in columns))
    once = (F.col("grp") == F.col("top")) | (F.col("a_id") < F.col("id"))
    # The sum of sizes is always positive; it keeps both sides' columns alike, so that they share one exchange.
    rule = once & (F.col("grp") != F.col("a_grp")) & near(*map(F.col, ("key", "sim", "a_sim", "length", "a_length"))) & (F.col("size") + F.col("a_size") > 0)
    found = a.join(keyed.hint("merge"), "key").where(rule)
    return _pairs(found)


def _groups(distinct: DataFrame, lines: DataFrame, rule: Rule, by_edits: bool) -> DataFrame:
    """id, label of every distinct line that is near another one: the smallest id of its group."""
    if by_edits:
        edit_keys = common.materialize(_edit_keys(lines), "edit-keys")
        keyed_lines = distinct.select("id", "k1", "k2", "sim", "length").join(edit_keys.hint("merge"), ["k1", "k2"])
        wide = keyed_lines.select("id", "sim", "length", F.explode("keys").alias("key"))
        shared = F.count(F.lit(1)).over(Window.partitionBy("key"))
        keyed = first = common.materialize(wide.withColumn("n", shared).where("n > 1").drop("n"), "keyed-lines")

        def near(key: Column, sim: Column, a_sim: Column, length: Column, a_length: Column) -> Column:
            free = key.bitwiseAND(F.lit(1)) == 0
            return _fits(length, a_length) & (free | (F.bit_count(sim.bitwiseXOR(a_sim)) <= TRIPLE_BITS))
    else:
        keys = block_keys(F.col("sim"), rule.blocks, rule.agree)
        # Copies share an end mostly, and else a quarter of the SimHash.
        first = F.concat(F.array("head", "tail"), block_keys(F.col("sim"), MOST_BITS + 1))
        first = distinct.select("id", "sim", "length", F.explode(first).alias("key"))

        def like(key: Column, sim: Column, a_sim: Column, length: Column, a_length: Column) -> Column:
            return rule.close(sim, a_sim) & _fits(length, a_length)

        def near(key: Column, sim: Column, a_sim: Column, length: Column, a_length: Column) -> Column:
            return like(key, sim, a_sim, length, a_length) & rule.first(key, sim, a_sim)

    common.free_shuffles(distinct.sparkSession)
    pairs = common.materialize(_leader_pairs(first, near if by_edits else like), "leader-pairs")
    links = common.materialize(_verified(pairs, _texts(pairs, distinct, lines)).select("a", "b"), "leader-links")
    found = connected_components(links).select(F.col("node").alias("id"), F.col("label").alias("grp"))
    grouped = distinct.select("id", "sim", "length").join(found.hint("merge"), "id", "left").withColumn("grp", F.coalesce("grp", "id"))
    sizes = common.materialize(found.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "group-sizes")
    grouped = grouped.join(sizes.hint("merge"), "grp", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    grouped = common.materialize(grouped.select("id", "sim", "length", "grp", "size"), "leader-groups")
    if by_edits:
        pairs = _crossing_pairs(keyed.join(grouped.select("id", "grp", "size").hint("merge"), "id"), near)
    else:
        # Always true, and what Spark would add to one side of the join only: said of both, it lets them share an exchange.
        labelled = grouped.where("grp is not null and sim is not null and length is not null and size is not null")
        pairs = _small_crossing_pairs(_hosted(labelled, rule), rule, near)
        large = labelled.where(F.col("size") > SMALL_GROUP)
        if not large.isEmpty():
            keyed = large.select("id", "length", "sim", "grp", "size", F.explode(keys).alias("key"))
            pairs = pairs.union(_crossing_pairs(keyed, near))
    common.free_shuffles(distinct.sparkSession)
    with _dealt_by_some_keys(distinct.sparkSession):
        pairs = common.materialize(pairs.distinct(), "crossing-pairs")
    joined = _joined_groups(pairs, distinct, lines)
    labels = grouped.select("id", "grp", "size").join(joined.hint("merge"), "grp", "left")
    return labels.where("size > 1 or label is not null").select("id", F.coalesce("label", "grp").alias("label"))


def _joined_groups(pairs: DataFrame, distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """grp, label: groups that some near pair joins to another one.

    One link joins two groups, however many pairs of lines would; so each group is
    first compared with the one beside it by the pair of the fewest different bits,
    and then only the pairs that are still in different groups and weren't compared.
    """
    texts = _texts(pairs, distinct, lines)

    def linked(some: DataFrame, tag: str) -> DataFrame:
        return common.materialize(_verified(some, texts).select("a_grp", "b_grp").distinct(), tag)

    low, high = F.least("a_grp", "b_grp"), F.greatest("a_grp", "b_grp")
    first = pairs.groupBy(high.alias("high")).agg(F.min(F.struct("bits", low.alias("low"), "a", "b", "a_grp", "b_grp")).alias("pair"))
    first = common.materialize(first.select("pair.a", "pair.b", "pair.a_grp", "pair.b_grp"), "first-pairs")
    links = linked(first, "first-links")
    joined = connected_components(links, "a_grp", "b_grp")
    rest = pairs
    for end in ("a", "b"):
        named = joined.select(F.col("node").alias(f"{end}_grp"), F.col("label").alias(f"{end}_label"))
        rest = rest.join(named.hint("merge"), f"{end}_grp", "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", f"{end}_grp"))
    rest = rest.where("a_label != b_label").select(*pairs.columns).join(first.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
    links = links.union(linked(common.materialize(rest, "other-pairs"), "other-links"))
    return connected_components(links, "a_grp", "b_grp").select(F.col("node").alias("grp"), "label")


@contextmanager
def _dealt_by_some_keys(spark: SparkSession) -> Iterator[None]:
    """Joins take rows that are dealt by some of their keys as they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _texts(pairs: DataFrame, distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """id, norm, words of the lines in some pair; only their texts are read again."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ends = common.materialize(distinct.select("id", "row", "pos").join(ends.hint("merge"), "id", "left_semi"), "near-lines")
    small = ends.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS
    texts = lines.select("row", "pos", "norm").join(F.broadcast(ends) if small else ends.hint("merge"), ["row", "pos"])
    # Words are split once for each line, not for each pair.
    return common.materialize(texts.select("id", "norm", F.split("norm", " ").alias("words")), "near-texts")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose edit distance is small; ``texts`` is what _texts makes of these pairs, or of more."""
    a = texts.select(F.col("id").alias("a"), F.length("norm").alias("m"), F.col("words").alias("x"))
    b = texts.select(F.col("id").alias("b"), F.length("norm").alias("n"), F.col("words").alias("y"))
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").withColumn("allowed", _allowed(F.greatest("m", "n")))
    return both.where(_near(F.col("x"), F.col("y"), F.col("allowed"))).select(*pairs.columns)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once: an expression of a filter is computed wherever it is named."""
    return F.transform(F.array(value), then)[0]


def _near(x: Column, y: Column, allowed: Column) -> Column:
    """Whether the edit distance of two lines, given as lists of words, is at most ``allowed``."""

    def by_words(w: Column) -> Column:
        return (_replaced(w.x, w.y) <= allowed) | _let(
            F.struct(F.array_join(w.x, " ").alias("s"), F.array_join(w.y, " ").alias("t")), lambda v: _near_texts(v.s, v.t, allowed)
        )

    # Words that both lines share at the start and at the end don't count for the distance.
    def from_start(start: Column) -> Column:
        cut = F.struct(F.slice(x, start + 1, F.size(x)).alias("x"), F.slice(y, start + 1, F.size(y)).alias("y"))
        return _let(cut, lambda w: _let(_shared(F.reverse(w.x), F.reverse(w.y)), lambda end: _let(
            F.struct(F.slice(w.x, F.lit(1), F.size(w.x) - end).alias("x"), F.slice(w.y, F.lit(1), F.size(w.y) - end).alias("y")), by_words
        )))

    return _let(_shared(x, y), from_start)


def _near_texts(s: Column, t: Column, allowed: Column) -> Column:
    m, n = F.length(s), F.length(t)
    # Bounded distances are -1 beyond the bound; Spark's cost the product of the lengths even if the bound is small.
    exact = F.call_function("levenshtein", s, t, allowed) >= 0
    return (F.abs(m - n) <= allowed) & ((F.greatest(m, n) <= allowed) | ((F.least(m, n) > 2 * PIECE) & _near_by_pieces(s, t, allowed)) | exact)


def _near_by_pieces(s: Column, t: Column, allowed: Column) -> Column:
    """Whether an upper bound of the edit distance is at most ``allowed``: the sum of the distances of aligned pieces.

    ``s`` is cut at equal distances, ``t`` where the characters after such a cut
    are next found. A cut that isn't found nearby is left out. However the texts
    are cut, their distance is at most the sum.
    """
    over = allowed + 1
    size = F.lit(PIECE)

    def added(at: Column, u: Column, v: Column) -> Column:
        most = allowed - at.cost
        within = (most >= 0) & (F.greatest(F.length(u), F.length(v)) <= 16 * size)
        return _let(F.when(within, F.call_function("levenshtein", u, v, most)).otherwise(F.lit(-1)), lambda d: F.when(d >= 0, at.cost + d).otherwise(over))

    def state(cost: Column, p: Column, q: Column) -> Column:
        return F.struct(cost.cast("int").alias("cost"), p.cast("int").alias("p"), q.cast("int").alias("q"))

    def cut(at: Column, i: Column) -> Column:
        p = i * size
        found = F.instr(F.substr(t, at.q + 1, p - at.p + 16 * size), F.substr(s, p + 1, F.lit(ANCHOR)))
        step = _let(found, lambda k: F.when(k == 0, at).otherwise(
            state(added(at, F.substr(s, at.p + 1, p - at.p), F.substr(t, at.q + 1, k - 1)), p, at.q + k - 1)
        ))
        return F.when(at.cost > allowed, at).otherwise(step)

    cuts = F.sequence(F.lit(1), F.floor((F.length(s) - ANCHOR) / size).cast("int"))
    nothing = F.lit(0)
    return F.aggregate(cuts, state(nothing, nothing, nothing), cut, lambda at: added(at, F.substr(s, at.p + 1), F.substr(t, at.q + 1)) <= allowed)


def _shared(x: Column | str, y: Column | str) -> Column:
    """How many words two lists share at their start."""
    until = F.array_position(F.zip_with(x, y, lambda u, v: F.coalesce(u == v, F.lit(False))), False)
    return F.when(until > 0, until - 1).otherwise(F.size(x)).cast("int")


def _replaced(x: Column, y: Column) -> Column:
    """For lines of as many words: the characters of words that differ place by place, an upper bound of the edit distance."""
    costs = F.zip_with(x, y, lambda u, v: F.when(u == v, 0).otherwise(F.greatest(F.length(u), F.length(v))))
    total = F.aggregate(costs, F.lit(0), lambda s, c: s + c)
    return F.when(F.size(x) == F.size(y), total).otherwise(F.lit(2**31 - 1))


def _decided(docs: DataFrame, rule: Rule, by_edits: bool) -> DataFrame:
    """row, doc_id, text_key, pos, worded, kept, copies of every line."""
    lines = common.materialize(_lines(docs), "lines")
    sims = _simhashes(lines)
    longest = lines.select(F.max("length")).first()[0] or 0
    if longest >= 2 * MOST_WORDS:
        sims = sims.union(_long_simhashes(lines.where(F.col("length") >= 2 * MOST_WORDS)).select(sims.columns))
    order = _order()
    distinct = sims.groupBy("k1", "k2").agg(
        F.min(order).alias("first"), F.min_by("row", order).alias("row"), F.min_by("pos", order).alias("pos"),
        F.count(F.lit(1)).alias("n"), *(F.max(c).alias(c) for c in ("sim", "length", "head", "tail")),
    )
    distinct = common.materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-lines")
    labels = _groups(distinct, lines, rule, by_edits)
    named = distinct.select("id", "k1", "k2", "first", "row", "pos", "n")
    grouped = named.join(labels.hint("merge"), "id", "left").where("n > 1 or label is not null")
    grouped = common.materialize(grouped.withColumn("label", F.coalesce("label", "id")), "line-groups")
    leaders = grouped.groupBy("label").agg(
        F.min_by("row", "first").alias("top_row"), F.min_by("pos", "first").alias("top_pos"), F.sum("n").alias("copies")
    )
    # Lines that occur once and are near no other stay.
    leaders = common.materialize(leaders.where("copies > 1"), "line-leaders")
    final = common.materialize(grouped.select("k1", "k2", "label").join(leaders.hint("merge"), "label").drop("label"), "line-final")
    occurrences = lines.select("row", "doc_id", "text_key", "pos", "k1", "k2", (F.col("length") > 0).alias("worded"))
    return occurrences.join(final.hint("merge"), ["k1", "k2"], "left").select(
        "row", "doc_id", "text_key", "pos", "worded",
        (~F.col("worded") | F.col("top_row").isNull() | ((F.col("row") == F.col("top_row")) & (F.col("pos") == F.col("top_pos")))).alias("kept"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
    )


def line_decisions(docs: DataFrame, by_edits: bool = False, rule: Rule = Rule()) -> DataFrame:
    """doc_id, pos, kept, copies of every line that has a word: whether it stays, and how many lines its group has."""
    return _decided(docs, rule, by_edits).where("worded").select("doc_id", "pos", "kept", "copies")


def line_dedup(docs: DataFrame, by_edits: bool = False, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_lines, n_kept, removed (positions of removed lines, in order), text_key (a hash of the text) of every row."""
    removed = F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("pos"))))
    by_row = _decided(docs, rule, by_edits).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_lines"), removed.alias("removed"), F.max("text_key").alias("text_key")
    )
    return by_row.select("doc_id", "n_lines", (F.col("n_lines") - F.size("removed")).alias("n_kept"), "removed", "text_key")


def without_lines(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` with removed lines cut out of ``text``; ``decided`` is a result of line_dedup for the same rows.

    Rows are matched by doc_id and text. Of rows that repeat both, one keeps the
    lines that stay, and the others, whose lines are all copies, lose theirs.
    """
    row, key = F.monotonically_increasing_id(), F.xxhash64(common.text_or_empty())
    rows = common.materialize(docs.withColumns({"__row": row, "__key": key}), "numbered-docs")
    first = rows.groupBy("doc_id", "__key").agg(F.min("__row").alias("__first"))
    size = F.size("removed")
    cut = decided.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).agg(
        F.min_by("removed", size).alias("__least"), F.max_by("removed", size).alias("__most")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text"))
    cut = first.join(cut.hint("merge"), same).select(F.col("doc_id").alias("__id"), "__text", "__first", "__least", "__most")
    cut = common.materialize(cut.where(F.size("__most") > 0), "cut-lines")
    joined = rows.join(cut.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text")), "left")
    gone = F.when(F.col("__row") == F.col("__first"), F.col("__least")).otherwise(F.col("__most"))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))
    text = F.when(F.col("__most").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("text", text).select(*docs.columns)
