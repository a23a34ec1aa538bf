"""Packing documents into fixed windows with minimum bin slack.

A document's token ids, closed by the id 1, are cut into whole windows and one
remainder. The remainders of the whole corpus are described by a histogram:
how many have each length (at most ``capacity`` entries, whatever the corpus).
Minimum bin slack then fills window after window: the longest remaining length
goes in, and a subset-sum program over a bitset (bit s is set if the lengths
taken so far can sum to s) finds the multiset of lengths that comes closest to
the rest of the window; backtracking through the bitsets gives how many of each
length. A window's multiset is repeated as long as the counts allow, so the
plan has few distinct windows and does not grow with the corpus.

Pieces get a rank within their length by a distributed two-step count (hot
lengths are dealt over salts), and a join with the plan turns rank into
sequence and offset. Tokens are made once; what is shuffled afterwards are
rows of five numbers.

Defined results: a null text counts as empty and gives one piece, the closing
id; an empty table gives no pieces; repeated rows are packed one by one; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm import common
from tracklake.llm.byte_bpe import ByteBpe

CAPACITY = 2048
END_ID = 1
#: Pieces of one length that share a salt, on average.
ROWS_PER_SALT = 50_000
LEAST_SALTS = 64


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset {length: how many} of one window: the longest length and the best rest."""
    longest = max(counts)
    target, reach, layers = capacity - longest, 1, []
    mask = (1 << (target + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), target // length)
        if left <= 0:
            continue
        layers.append((length, reach))
        step = 1
        while left:  # 1, 2, 4, ... copies and a rest reach every number of copies up to the count
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
        if reach >> target:
            break
    rest, chosen = reach.bit_length() - 1, {longest: 1}
    for length, before in reversed(layers):
        copies = 0
        while not before >> rest & 1:
            rest -= length
            copies += 1
        if copies:
            chosen[length] = chosen.get(length, 0) + copies
    return chosen


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, copies in a window, first sequence, first offset)."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    used: dict[int, int] = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while counts:
        chosen = fill_window(counts, capacity)
        repeats = min(counts[k] // n for k, n in chosen.items())
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * repeats, n, sequence, offset))
            used[length] += n * repeats
            counts[length] -= n * repeats
            if not counts[length]:
                del counts[length]
            offset += n * length
        sequence += repeats
    return rows


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and the piece's ids) of every piece."""
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = ByteBpe(vocabulary), END_ID.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = bpe.encode(text) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), total, piece)
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=False)], names[: len(out)])

    return docs.select(F.col("doc_id").cast("bigint"), common.text_or_empty().alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    pieces = common.materialize(pieces_of(docs, vocabulary, capacity, with_ids), "pieces")
    salts = max(LEAST_SALTS, pieces.count() // ROWS_PER_SALT)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = common.materialize(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan_windows(histogram, capacity)
    plan = spark.createDataFrame(
        rows, "length bigint, first_rank bigint, end_rank bigint, copies bigint, first_sequence bigint, first_offset bigint"
    )
    before = counts.select(
        "length", "salt",
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"),
    )
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = (
        salted.withColumn("own", own)
        .join(before.hint("merge"), ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("own") - 1)
        .drop("own", "before", "salt")
    )
    # The plan has at most a few rows for each of the ``capacity`` lengths: safe to broadcast at any scale.
    at = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(F.broadcast(plan), "length")
        .where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            (F.col("first_sequence") + F.floor(at / F.col("copies"))).cast("bigint").alias("sequence_id"),
            (F.col("first_offset") + F.pmod(at, F.col("copies")) * F.col("length")).cast("bigint").alias("offset"),
            *(["ids"] if with_ids else []),
        )
    )
