"""Exact deduplication against a persistent digest index, with DataFrame operations only.

The index is a table bucketed and sorted by the SHA-256 of the normalised text.
A batch is reduced to its digests (the texts are read once and never
shuffled), its new digests are found with a sort-merge anti-join against the
index, and they are appended, one file for each bucket. Which row of a text
stays is then read from the index.

Texts are equal when they are identical after each run of ASCII white space
became one space. Of equal texts the row with the smallest doc_id stays, unless
an earlier batch already put the text into the index: then that row stays.

Defined results: a null text counts as empty; rows repeated with one doc_id and
equal texts share ``kept``, and rows of one doc_id with different texts are
different documents; a null doc_id is never the smallest if another row of the
group has an id, and rows without any share ``kept``; an empty batch gives an empty result and
leaves the index as it is. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import common

#: Digests in one bucket of the index, about 400 MB of 100 bytes.
ROWS_PER_BUCKET = 4_000_000
LEAST_BUCKETS = 8
#: Batches in which a single table goes through the index.
BATCHES = 2
_COLUMNS = "digest string, keep_id bigint, batch bigint"


def normalized(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


class DigestIndex:
    """The persistent table of digests at ``path``.

    ``buckets`` belongs to the stored files and must be the same whenever the
    index is opened. ``name`` is the table's name in the session's catalog; the
    files are registered again under it when another session opens them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = LEAST_BUCKETS, name: str | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = name or "digest_index_" + path.rstrip("/").rpartition("/")[2].replace("-", "_")
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"create table {self.name} ({_COLUMNS}) using parquet clustered by (digest) "
                f"sorted by (digest) into {buckets} buckets location '{path}'"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame, batch: int) -> None:
        """Add the texts of a batch (doc_id, text_sha256) that the index lacks, each with its smallest doc_id."""
        firsts = digests.groupBy(F.col("text_sha256").alias("digest")).agg(F.min("doc_id").cast("bigint").alias("keep_id"))
        new = firsts.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (
            new.select("digest", "keep_id", F.lit(batch).cast("bigint").alias("batch"))
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest")
            .mode("append").format("parquet").option("path", self.path).saveAsTable(self.name)
        )

    def close(self) -> None:
        """Take the table out of the session's catalog; its files stay."""
        self.spark.sql(f"drop table if exists {self.name}")


def _digests(docs: DataFrame) -> DataFrame:
    return common.materialize(docs.select("doc_id", digest(common.text_or_empty()).alias("text_sha256")), "digests")


def _known(digests: DataFrame, index: DigestIndex) -> DataFrame:
    """text_sha256, keep_id (as the index has it), group_size of every text of ``digests``."""
    sizes = digests.groupBy(F.col("text_sha256").alias("digest")).agg(F.count(F.lit(1)).alias("group_size"))
    found = sizes.join(index.rows().select("digest", "keep_id").hint("merge"), "digest")
    return common.materialize(found.select(F.col("digest").alias("text_sha256"), "keep_id", "group_size"), "digest-groups")


def _placed(digests: DataFrame, known: DataFrame) -> DataFrame:
    """Both sides are plain scans, so a digest that a third of all rows have is split by the adaptive skew join."""
    return digests.join(known.hint("merge"), "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def dedup_batch(docs: DataFrame, index: DigestIndex, batch: int = 0) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; appends to ``index``.

    ``group_size`` counts the rows of this batch; ``keep_id`` is read from the
    index, so it is that of an earlier batch if one had the text.
    """
    digests = _digests(docs)
    index.append(digests, batch)
    return _placed(digests, _known(digests, index))


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET))


def exact_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One table, put into a new index batch by batch in the order of doc_id; ``group_size`` counts all its rows.

    Batches are ranges of doc_id between approximate quantiles, so a text's row
    of the smallest doc_id is the first to reach the index.
    """
    spark = docs.sparkSession
    digests = _digests(docs)
    index = DigestIndex(spark, common.new_path(spark, "digest-index"), buckets_for(digests.count()))
    shares = [i / batches for i in range(1, batches)]
    found = digests.select(F.percentile_approx("doc_id", shares, 1000).alias("borders")).first() if shares else None
    borders = sorted(set(found.borders or [])) if found else []
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1))  # rows without an id come last
    for batch, (low, high) in enumerate(zip([None, *borders], [*borders, None], strict=True)):
        inside = F.lit(True) if low is None else order > low
        index.append(digests.where(inside if high is None else inside & (order <= high)), batch)
    known = _known(digests, index)
    index.close()
    return _placed(digests, known)


ORACLE = r"""
    with d as (
      select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
      from documents),
    g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by 1)
    select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256
    from d join g using (text_sha256)"""
