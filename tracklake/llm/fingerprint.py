"""Document fingerprints by consistent weighted sampling, with DataFrame operations only.

A document's terms are its words, lower-cased; a term weighs as much as it
occurs. For every sample k a term of weight S draws, from hashes of the term and
k alone, r and c of a Gamma(2, 1) distribution and b uniform in (0, 1). With
t = floor(ln S / r + b) and y = exp(r (t - b)), the term with the least
a = c / (y exp(r)) is the sample. Two texts have the same sample with a
probability of the generalised Jaccard similarity of their weights, the sum of
the lesser weights over the sum of the greater.

Two uniform numbers give both r and b: if e1 and e2 are exponential, e1 + e2 is
Gamma(2, 1) and e1 / (e1 + e2) is uniform and independent of it. Then
a = c u2 (u1 u2)^t, where the u are those numbers, and t = 0 as long as
S u2 < 1, which spares most terms the second logarithm. Since a is a function of
term, k and t, the least a itself names the sample; a fingerprint holds 32 bits
of its hash.

The next document in the order of doc_id is found without bringing all rows to
one task: ranges of the order are dealt to tasks, and the first row of each
range is also sent to the range before it. One exchange moves the texts; terms,
samples and comparisons are computed where it leaves them.

Defined results: a null text counts as empty; a text without words is its own
single term; so all fingerprints have as many samples, and equal texts equal
ones. Rows without doc_id come last, rows that share a doc_id are ordered by a
hash of their texts; rows that repeat both are each other's next documents, and
are the only ones that must share a task. A table of one row is its own next
document; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm import common

SAMPLES = 48
#: Ranges of the order dealt to one shuffle partition, on average.
RANGES_PER_PARTITION = 4
#: A word: letters and digits of any alphabet.
WORD = r"[\p{L}\p{N}]+"
#: Bits of a uniform number; three fit into one 64-bit hash.
BITS = 21
_KEY = "struct<late: boolean, id: bigint, tie: bigint>"


def terms_of(text: Column | str) -> Column:
    """The sorted hashes of all words, repeated ones too."""
    given = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(given), F.lit(WORD), F.lit(0))
    return F.sort_array(F.transform(F.when(F.size(words) == 0, F.array(given)).otherwise(words), lambda w: F.xxhash64(w)))


def weighted(df: DataFrame, hashes: str) -> DataFrame:
    """A row for each distinct term (``term``, ``weight``) of the sorted array ``hashes``."""
    at, ends = F.col(hashes), F.col("__ends")
    last = lambda i: (i == F.size(at)) | (F.get(at, i) != F.get(at, i - 1))
    run = lambda end, i: F.struct(F.get(at, end - 1).alias("term"), (end - F.when(i == 0, 0).otherwise(F.get(ends, i - 1))).alias("weight"))
    ended = df.withColumn("__ends", F.filter(F.sequence(F.lit(1), F.size(at)), last))
    keep = [c for c in df.columns if c != hashes]
    out = ended.select(*keep, F.inline(F.transform(ends, run)))
    weight = F.coalesce("weight", F.lit(1)).cast("double")
    return out.select(*keep, F.coalesce("term", F.lit(0)).alias("term"), weight.alias("weight"), F.ln(weight).alias("log_weight"))


def sample(k: int) -> Column:
    """The value a of ``term`` and ``weight`` for sample ``k``."""

    def uniform(bits: Column, n: int) -> Column:
        return (F.shiftrightunsigned(bits, BITS * n).bitwiseAND(F.lit((1 << BITS) - 1)) + F.lit(0.5)) * F.lit(2.0**-BITS)

    draws = F.xxhash64(F.col("term").bitwiseXOR(F.lit(2 * k)))
    more = F.xxhash64(F.col("term").bitwiseXOR(F.lit(2 * k + 1)))
    c, u2, u1 = -F.ln(uniform(draws, 0) * uniform(draws, 1)), uniform(draws, 2), uniform(more, 0)
    r = -F.ln(u1 * u2)
    t = F.floor((F.col("log_weight") - F.ln(u1)) / r)
    return F.when(F.col("weight") * u2 < 1, c * u2).otherwise(c * u2 * F.exp(-r * t))


def fingerprints(df: DataFrame, keys: list[str], hashes: str = "terms", samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``marks``, an array of 32-bit numbers, for each row of sorted term hashes; ``keys`` tell rows apart."""
    least = weighted(df.select(*keys, hashes), hashes).groupBy(*keys).agg(*(F.min(sample(k)).alias(f"__{k}") for k in range(samples)))
    marks = F.transform(F.array(*(f"__{k}" for k in range(samples))), lambda a: F.xxhash64(a).bitwiseAND(F.lit(0xFFFFFFFF)))
    return least.select(*keys, marks.alias("marks"))


def as_text(marks: Column) -> Column:
    """A fingerprint as eight hexadecimal digits for each sample."""
    return F.array_join(F.transform(marks, lambda m: F.lpad(F.lower(F.hex(m)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples, an estimate of the generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def _keyed(docs: DataFrame) -> DataFrame:
    given, text = F.col("doc_id").cast("bigint"), common.text_or_empty()
    rows = docs.select(given.alias("doc_id"), text.alias("text"))
    key = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("tie"))
    return rows.withColumn("key", key)


def _borders(keyed: DataFrame, ranges: int) -> list[tuple[bool, int, int]]:
    """The least key of each range of the order; the ranges are those of Spark's own range partitioning."""
    dealt = keyed.select("key.*").repartitionByRange(ranges, "late", "id", "tie")
    least = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("late", "id", "tie")).alias("key"))
    return sorted(tuple(r.key) for r in least.collect())


class _Ranges:
    """Finds the range of a key among sorted borders, by groups of about the square root of their number."""

    def __init__(self, borders: list[tuple[bool, int, int]]):
        rows = [dict(zip(("late", "id", "tie"), b, strict=True)) for b in borders]
        self.step = math.isqrt(len(rows) - 1) + 1
        groups = [rows[i : i + self.step] for i in range(0, len(rows), self.step)]
        self.tops = F.from_json(F.lit(json.dumps([g[0] for g in groups])), f"array<{_KEY}>")
        self.groups = F.from_json(F.lit(json.dumps(groups)), f"array<array<{_KEY}>>")

    def of(self, keyed: DataFrame) -> DataFrame:
        """With ``range``, and with ``first``: whether the key is the range's border."""
        key, group, place = F.col("key"), F.col("__group"), F.col("__place")
        df = keyed.withColumn("__group", F.size(F.filter(self.tops, lambda b: b <= key)) - 1)
        df = df.withColumn("__place", F.size(F.filter(F.get(self.groups, group), lambda b: b <= key)) - 1)
        return df.select("*", (group * self.step + place).alias("range"), (F.get(F.get(self.groups, group), place) == key).alias("first")).drop("__group", "__place")


def with_next(docs: DataFrame) -> DataFrame:
    """range, row, doc_id, text, next_text, extra of every document in the order of doc_id.

    Rows with ``extra`` are the first ones of the following range, there again
    so that every range knows what follows it.
    """
    keyed = _keyed(docs)
    borders = _borders(keyed, RANGES_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) or [(False, 0, 0)]
    placed = _Ranges(borders).of(keyed)
    heads = placed.where("first").dropDuplicates(["range"])
    heads = heads.withColumn("range", F.pmod(F.col("range") - 1, F.lit(len(borders))))
    rows = placed.withColumn("extra", F.lit(False)).unionByName(heads.withColumn("extra", F.lit(True)))
    order = Window.partitionBy("range").orderBy("extra", "key")
    return rows.select(
        "range", F.row_number().over(order).alias("row"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "extra"
    )


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The fingerprint of each text and of its edited text, and how like they and the next document are.

    The edited text has the last half of the text, rounded down, replaced by as
    many code points of the beginning of the next document.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2)
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next_text", F.lit(1), half.cast("int")))
    rows = rows.withColumn("edited", F.when(~F.col("extra"), edited))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    both = F.array(F.struct(F.lit(0).alias("edit"), F.col("text").alias("of")), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("of")))
    texts = rows.select("range", "row", "doc_id", "n_chars", "edited_sha256", "extra", F.inline(both)).where("of is not null")
    keys = ["range", "row", "edit", "doc_id", "n_chars", "edited_sha256", "extra"]
    found = fingerprints(texts.select(*keys, terms_of("of").alias("terms")), keys, samples=samples)
    # In this order the edited text follows its own, and the next document's text follows both.
    order = Window.partitionBy("range").orderBy("row", "edit")
    lined = found.select("*", F.lead("marks", 1).over(order).alias("edited"), F.lead("marks", 2).over(order).alias("following"))
    return lined.where("edit = 0 and not extra").select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("marks")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited")).alias("near_edited"), likeness(F.col("marks"), F.col("following")).alias("near_next"),
    )
