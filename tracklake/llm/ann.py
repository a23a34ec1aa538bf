"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample. Every vector is put into the list of
its nearest centroid and, near a border, into those of further centroids within
a distance ratio, looked up in a neighbour graph that each task holds in memory.
A query searches the same graph for some number of nearest centroids and reads
the lists of those within a distance ratio of the nearest one. Neither is fixed:
a sample is answered by brute force, and the number and the ratio are what it
needs for the target recall. The sample is of queries only if these are many;
otherwise it is of all vectors, so queries are never answered by their own
calibration. A query that finds too few vectors so reads all lists. Long lists are cut into blocks, so no task holds more than a
block however many vectors crowd around one centroid.

Equal vectors are one entry that carries the few smallest ids which can appear
in any result. Candidates of a query are compared exactly, in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part; only vectors of the query's
own length are its candidates; a query without any candidate gives no rows, and
one with fewer than ten gives all; repeated ids are answered once, for the
vector whose hash is smallest; extra columns are ignored. Lengths of few vectors
are compared in full, all in one job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm import common

NEAREST = 10
#: Vectors for each centroid, on average (fewer in tables of less than its square: as many centroids as vectors for each),
#: and centroids at most (4 kB each with their links in every task).
LIST_ROWS, MOST_CENTROIDS = 256, 8192
#: Distinct vectors that the centroids are fitted on, at most.
SAMPLE_VECTORS = 20_000
#: Rows of a block of a list.
BLOCK_ROWS = 4096
#: Links of each centroid in the graph, and centroids that a search keeps.
LINKS, BEAM = 24, 64
#: A vector also joins lists whose centroid is at most this much farther than its nearest.
REPLICA_RATIO = 1.08
#: Lists of one vector at most; one is enough for it to be found, so none is lost.
MOST_REPLICAS = 4
#: Vector lengths of at most so many vectors, those of one list, are compared in full.
FEW_VECTORS = 256
#: Vectors answered by brute force to set the number of lists, and the share of their neighbours that those must hold.
CALIBRATION, CALIBRATED_RECALL = 256, 0.97
#: The calibration takes queries if it needs one in so many of them at most, otherwise any vectors.
SHARE_OF_QUERIES = 4
#: A query that lies on a centroid has no ratio: it counts as this quantile of the calibration's distances from the nearest.
CLOSE = 0.25


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    number = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & number & F.exists(v, lambda x: x != 0), F.lit(False))


# -- centroids and their graph


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, rows of ``a`` by rows of ``b``."""
    d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
    return np.maximum(d, 0)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means; in each round the emptiest centroids move into the fullest lists, which balances them."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for step in range(rounds):
        owner = np.concatenate([_distances(x[i : i + 2048], centroids).argmin(1) for i in range(0, len(x), 2048)])
        sizes = np.bincount(owner, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, x)
        full = sizes > 0
        centroids[full] = sums[full] / sizes[full, None]
        if step < rounds - 2:
            order = np.argsort(sizes)
            for low, high in zip(order, order[::-1], strict=True):
                if sizes[high] <= 2 * len(x) / k or sizes[low] * 3 > sizes[high]:
                    break
                members = np.flatnonzero(owner == high)
                centroids[low] = x[rng.choice(members)]
    return centroids


@dataclass
class CentroidGraph:
    """Centroids linked to their nearest ones and to a few far ones."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, seed: int = 6) -> CentroidGraph:
        n, rng = len(centroids), np.random.default_rng(seed)
        near = min(LINKS, n - 1)
        links = np.empty((n, near + min(4, n)), np.int32)
        for i in range(0, n, 1024):
            d = _distances(centroids[i : i + 1024], centroids)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            links[i : i + 1024, :near] = np.argsort(d, axis=1)[:, :near]
        links[:, near:] = rng.integers(0, n, (n, links.shape[1] - near))
        entries = rng.choice(n, min(n, BEAM), replace=False)
        return cls(centroids, links, entries.astype(np.int32))

    def _start(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        dist = _distances(x, self.centroids[self.entries[:width]])
        order = np.argsort(dist, axis=1, kind="stable")
        return self.entries[:width][order], np.take_along_axis(dist, order, 1)

    def search(self, x: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` centroids found nearest, nearest first, and their distances: a beam search for all rows at once."""
        n, width = len(x), min(width, len(self.centroids))
        if width > len(self.entries):  # so wide a beam starts from what a narrow one finds
            near, far = self.search(x, len(self.entries))
            beam, dist = np.full((n, width), len(self.centroids), np.int32), np.full((n, width), np.inf)  # an empty place is infinitely far
            beam[:, : near.shape[1]], dist[:, : near.shape[1]] = near, far**2
        else:
            beam, dist = self._start(x, width)
        expanded = np.isinf(dist)
        norms = (self.centroids * self.centroids).sum(1)
        own = (x * x).sum(1)
        active = np.arange(n)
        while len(active):
            # each active row expands its nearest centroid that it hasn't expanded, a few at a time
            open_ = ~expanded[active]
            rank = np.cumsum(open_, axis=1)
            pick = open_ & (rank <= 4)
            expanded[active] |= pick
            at = np.argsort(~pick, axis=1, kind="stable")[:, :4]
            valid = np.take_along_axis(pick, at, 1)
            chosen = np.take_along_axis(beam[active], at, 1)
            new = self.links[chosen]
            new[~valid] = -1
            new = new.reshape(len(active), -1)
            new.sort(axis=1)
            repeated = np.zeros(new.shape, bool)
            repeated[:, 1:] = new[:, 1:] == new[:, :-1]
            known = self._among(new, beam[active])
            bad = repeated | known | (new < 0)
            d = own[active, None] + norms[new] - 2 * np.einsum("rd,rkd->rk", x[active], self.centroids[new])
            d = np.where(bad, np.inf, np.maximum(d, 0))
            all_ids, all_dist = np.hstack([beam[active], new]), np.hstack([dist[active], d])
            seen = np.hstack([expanded[active], np.zeros(new.shape, bool)])
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
            beam[active] = np.where(np.isinf(np.take_along_axis(all_dist, order, 1)), len(self.centroids), np.take_along_axis(all_ids, order, 1))
            dist[active] = np.take_along_axis(all_dist, order, 1)
            expanded[active] = np.take_along_axis(seen, order, 1) | np.isinf(dist[active])
            active = active[(~expanded[active][:, : max(1, width // 2)]).any(1)]
        return beam, np.sqrt(dist)

    def _among(self, new: np.ndarray, beam: np.ndarray) -> np.ndarray:
        """Whether each number of a row of ``new`` is in the same row of ``beam``."""
        held = np.zeros((len(beam), len(self.centroids) + 1), bool)
        np.put_along_axis(held, beam, True, 1)
        return np.take_along_axis(held, new, 1)


def lists_of(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) for the nearest centroid of each row and the next ones within REPLICA_RATIO of its distance."""
    found, dist = graph.search(x)
    keep = dist <= REPLICA_RATIO * dist[:, :1] + 1e-12
    keep &= np.cumsum(keep, axis=1) <= MOST_REPLICAS
    rows, at = np.nonzero(keep)
    return rows, found[rows, at]


@dataclass
class Reach:
    """Which lists a query reads: the ``width`` nearest at most, of centroids within ``ratio`` of the nearest one's distance, or of ``close`` if that is less."""

    ratio: float
    width: int
    close: float = 0.0


def probes_of(graph: CentroidGraph, x: np.ndarray, reach: Reach) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) for the lists that each row reads, its nearest one at least."""
    found, dist = graph.search(x, max(reach.width, BEAM))
    keep = np.isfinite(dist) & (dist <= reach.ratio * np.maximum(dist[:, :1], reach.close) + 1e-12)
    keep[:, reach.width :] = False
    rows, at = np.nonzero(keep)
    return rows, found[rows, at]


def all_lists(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(graph.centroids)
    return np.repeat(np.arange(len(x)), n), np.tile(np.arange(n), len(x))


# -- the index


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def _place(rows: DataFrame, lists_for: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], id_name: str) -> DataFrame:
    """list, id of every list that ``lists_for`` names for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                r, lists = lists_for(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int64)), batch.column(0).take(pa.array(r))], ["list", id_name])

    return rows.select(id_name, "vec").mapInArrow(run, f"list bigint, {id_name} bigint")


def _true_neighbours(entries: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """query, vec: the ``k`` nearest entries of each of a few vectors other than its own, compared with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, score = np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0))
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                own = batch.column(0).to_numpy()
                d = _distances(x, _matrix(batch.column(1)))
                d[ids[:, None] == own] = np.inf
                score, rep = np.hstack([score, d]), np.hstack([rep, np.broadcast_to(own, d.shape)])
                best = np.argsort(score, axis=1, kind="stable")[:, :k]
                score, rep = np.take_along_axis(score, best, 1), np.take_along_axis(rep, best, 1)
        query = np.broadcast_to(ids[:, None], score.shape)
        real = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([pa.array(c[real]) for c in (query, rep, score)], ["query", "rep", "score"])

    found = entries.select("rep", "vec").mapInArrow(run, "query bigint, rep bigint, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "rep"))
    best = common.materialize(found.withColumn("place", place).where(F.col("place") <= k).select("query", "rep"), "true-neighbours")
    return entries.select("rep", "vec").join(F.broadcast(best), "rep").select("query", "vec")  # k rows for each of a few vectors


def reach_for(entries: DataFrame, wanted: DataFrame, graph: CentroidGraph, k: int) -> Reach:
    """The distance ratio, and the number of nearest lists, that together leave CALIBRATED_RECALL of the true neighbours of a sample."""
    n = len(graph.centroids)
    everything = Reach(math.inf, n)
    if n == 1:
        return everything
    enough = CALIBRATION * SHARE_OF_QUERIES
    source = wanted if wanted.select("rep").limit(enough).count() == enough else entries
    sample = source.select("rep", "vec").orderBy(F.xxhash64(F.lit("calibration"), "rep"), "rep").limit(CALIBRATION).toArrow()
    if not sample.num_rows:
        return everything
    ids, x = sample.column(0).to_numpy(), _matrix(sample.column(1))
    true = _true_neighbours(entries, ids, x, k).toArrow()
    if not true.num_rows:
        return everything
    rows, lists = lists_of(graph, _matrix(true.column(1)))
    row_of = {int(q): i for i, q in enumerate(ids)}
    query = np.array([row_of[q] for q in true.column(0).to_pylist()])
    d = np.sqrt(_distances(x, graph.centroids))
    order = np.sort(d, axis=1)
    first = np.full(true.num_rows, np.inf)  # the distance of the nearest list that holds each neighbour
    np.minimum.at(first, rows, d[query[rows], lists])
    place = (order[query] < first[:, None]).sum(1) + 1
    close = max(float(np.quantile(order[:, 0], CLOSE)), 1e-12)
    needed = first / np.maximum(order[query, 0], close)
    # Each of the two limits may lose half of what may be lost.
    at = math.ceil((1 + CALIBRATED_RECALL) / 2 * len(needed)) - 1
    return Reach(float(np.sort(needed)[at]) * (1 + 1e-9), int(np.sort(place)[at]), close)


def _compare(rows: DataFrame, keep: int) -> DataFrame:
    """query, rep, score: the nearest entries of each query within each block (list, block, is_query, id, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in aligned(batches, 2, BLOCK_ROWS):
            lists, block = table.column(0).to_numpy(), table.column(1).to_numpy()
            is_query, ids = table.column(2).to_numpy(zero_copy_only=False).astype(bool), table.column(3).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (lists[1:] != lists[:-1]) | (block[1:] != block[:-1])]))
            out_q, out_r, out_s = [], [], []
            for a, b in zip(first, [*first[1:], len(lists)], strict=True):
                q, p = np.flatnonzero(is_query[a:b]), np.flatnonzero(~is_query[a:b])
                if not len(q) or not len(p):
                    continue
                x, own = _matrix(table.column(4).slice(a, b - a)), ids[a:b]
                for lo in range(0, len(q), 512):
                    part = q[lo : lo + 512]
                    d = _distances(x[part], x[p])
                    n = min(len(p), keep)
                    limit = np.partition(d, n - 1, axis=1)[:, n - 1]
                    # what rounding could have put on the wrong side of the limit is compared exactly too
                    scale = (x[part] ** 2).sum(1) + (x[p] ** 2).sum(1).max()
                    near = d <= (limit + 1e-12 * scale)[:, None]
                    i, j = np.nonzero(near)
                    exact = np.sqrt(((x[part[i]] - x[p[j]]) ** 2).sum(1))
                    out_q.append(own[part[i]])
                    out_r.append(own[p[j]])
                    out_s.append(exact)
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_q, out_r, out_s)], ["query", "rep", "score"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("list", "block", "is_query", "id", "vec").repartition(n, "list", "block").sortWithinPartitions("list", "block")
    return placed.mapInArrow(run, "query bigint, rep bigint, score double")


def aligned(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or one group; the first ``keys`` columns name a group, whose rows come together."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(len(table), bool)
        for k in range(keys):
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        last = np.flatnonzero(change)
        if len(last):
            cut = int(last[-1])
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            count = len(table) - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def _entries(rows: DataFrame, keep: int) -> DataFrame:
    """Equal vectors as one entry: rep, vec, ids (the ``keep`` smallest). A group is cut down before the shuffle."""
    own = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    small = rows.withColumn("place", own).where(F.col("place") <= keep)
    return small.groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("vec", "vec_id").alias("vec")
    )


def _queries(rows: DataFrame, entries: DataFrame, queries: Column) -> DataFrame:
    """vec_id, rep: the rows that are asked for; of rows that repeat an id the one of the smallest hash."""
    asked = rows.where(queries).groupBy("vec_id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("vec_id", "k.k1", "k.k2")
    return common.materialize(asked.join(entries.select("k1", "k2", "rep").hint("merge"), ["k1", "k2"]).select("vec_id", "rep"), "queries")


def _answers(postings: DataFrame, probes: DataFrame, entries: DataFrame, wanted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, hits (score, vec_id; nearest first) from postings and probes (list, rep)."""
    keep = k + 1  # a query's own row is among its candidates' ids at most once
    blocks = common.materialize(
        postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")), "list-sizes"
    )
    at = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # At most MOST_CENTROIDS rows, or one for each of as many lengths of few vectors as were counted.
    small = blocks.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS
    sized = F.broadcast(blocks) if small else blocks.hint("merge")
    p = postings.join(sized, "list").select("rep", "list", at.alias("block"))
    q = probes.join(sized, "list").select("rep", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    p = p.join(entries.select("rep", "vec").hint("merge"), "rep").withColumn("is_query", F.lit(False))
    q = q.join(wanted.hint("merge"), "rep").withColumn("is_query", F.lit(True))
    found = common.materialize(_compare(p.unionByName(q).withColumnRenamed("rep", "id"), keep), "candidates")
    by_query = Window.partitionBy("query")
    best = (
        found.groupBy("query", "rep").agg(F.min("score").alias("score"))
        .withColumn("place", F.row_number().over(by_query.orderBy("score", "rep"))).where(F.col("place") <= keep)
        .join(entries.select("rep", "ids").hint("merge"), "rep")
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("place", F.row_number().over(by_query.orderBy("score", "vec_id"))).where(F.col("place") <= keep)
        .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    )
    answers = asked.withColumnRenamed("vec_id", "query_id").join(best.hint("merge"), asked.rep == best.query)
    hits = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return common.materialize(answers.select("query_id", "rep", hits.alias("hits")), "answers")


def _search_one_length(rows: DataFrame, queries: Column, k: int) -> DataFrame:
    """query_id, hits for the vectors of one length, which are many."""
    entries = common.materialize(_entries(rows, k + 1), "entries")
    n = entries.count()
    share = min(1.0, SAMPLE_VECTORS / max(1, n))
    sample = entries.where(F.pmod(F.xxhash64(F.lit("sample"), "rep"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("vec")
    x = _matrix(sample.toArrow().column(0))  # bounded by SAMPLE_VECTORS
    if not len(x):
        x = _matrix(entries.select("vec").limit(1).toArrow().column(0))
    graph = CentroidGraph.build(fit_centroids(x, max(1, min(MOST_CENTROIDS, max(n // LIST_ROWS, math.isqrt(n))))))
    asked = _queries(rows, entries, queries)
    wanted = common.materialize(
        entries.select("rep", "vec").join(asked.select("rep").distinct().hint("merge"), "rep"), "query-vectors"
    )
    reach = reach_for(entries, wanted, graph, k)
    postings = common.materialize(_place(entries, partial(lists_of, graph), "rep"), "postings")
    probes = common.materialize(_place(wanted, partial(probes_of, graph, reach=reach), "rep"), "probes")
    found = _answers(postings, probes, entries, wanted, asked, k)
    # Every query has at least k candidates here, or all there are; one that found fewer reads every list.
    most = entries.select(F.sum(F.size("ids"))).first()[0] - 1
    short = asked.join(found.where(F.size("hits") >= min(k, most)).select(F.col("query_id").alias("vec_id")).hint("merge"), "vec_id", "left_anti")
    short = common.materialize(short, "short-queries")
    if short.isEmpty():
        return found.select("query_id", "hits")
    again = common.materialize(wanted.join(short.select("rep").distinct().hint("merge"), "rep"), "short-vectors")
    probes = common.materialize(_place(again, partial(all_lists, graph), "rep"), "probes")
    enough = found.join(short.select(F.col("vec_id").alias("query_id")).hint("merge"), "query_id", "left_anti")
    return enough.unionByName(_answers(postings, probes, entries, again, short, k)).select("query_id", "hits")


def _search_few(rows: DataFrame, queries: Column, k: int) -> DataFrame:
    """query_id, hits for vectors of lengths that few have: each length is one list that all its queries read."""
    entries = common.materialize(_entries(rows, k + 1), "entries")
    asked = _queries(rows, entries, queries)
    wanted = common.materialize(entries.select("rep", "vec").join(asked.select("rep").distinct().hint("merge"), "rep"), "query-vectors")
    by_length = F.size("vec").cast("bigint").alias("list")
    return _answers(entries.select(by_length, "rep"), wanted.select(by_length, "rep"), entries, wanted, asked, k).select("query_id", "hits")


def nearest(rows: DataFrame, queries: Column | None = None, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows found for each row that ``queries`` selects.

    ``rows`` has vec_id and embedding. By default every row whose vec_id is
    divisible by 100 is a query.
    """
    if queries is None:
        queries = F.col("vec_id") % 100 == 0
    vec = F.col("embedding").cast("array<double>")
    v = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    # Zeros of either sign are equal.
    v = v.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    v = v.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec"), "length": F.size("vec")})
    v = common.materialize(v, "vectors")
    sizes = common.materialize(v.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "length-sizes")
    many = sorted(r["length"] for r in sizes.where(F.col("n") > FEW_VECTORS).collect())  # at most a row for each FEW_VECTORS vectors
    found = [_search_one_length(v.where(F.col("length") == n), queries, k) for n in many]
    if len(many) < sizes.count():
        found.append(_search_few(v.where(~F.col("length").isin(many)) if many else v, queries, k))
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return reduce(DataFrame.unionByName, found).select("query_id", F.posexplode("hits").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def recall(found: set[tuple[int, int]], true: set[tuple[int, int]]) -> float:
    """The share of true (query, neighbour) pairs found."""
    return len(found & true) / len(true) if true else math.nan
