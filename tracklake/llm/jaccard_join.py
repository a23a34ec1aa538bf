"""Similarity join of documents by the Jaccard index of word shingles: a chosen-path join.

Texts are sets of hashed shingles of five words. Sets go down trees of
buckets. In each node some minhash coordinates are sampled, and a set moves on
to a child for each of them, named by its own value there, so only sets that
share sampled tokens stay together. A bucket small enough stops and is compared
by brute force. One run finds a pair of similarity 0.8 with a probability of
at least 1 - 1/e on each level, and runs with fresh samples are repeated until
the target recall is reached.

Comparing in buckets uses minhash sketches, and keeps only a spanning forest of
the similar sets, so no list of all pairs in a bucket is ever made. The forests
give candidate groups. Within each group all sets are then compared exactly, in
blocks, by products of sparse incidence blocks; these blocks count links and
again pass on only spanning forests, whose components are the classes. In a
large group, sets within half of the allowed distance of one leader are linked
to each other by the triangle inequality, and are not compared.

Copies (equal shingle sets) are joined first and appear once in all this. The
shuffles carry ids and sketches; full sets are made again only for members of
candidate groups.

Defined results: words are separated by white space; a text of fewer than five
words is one shingle of all its words; null and empty texts have the empty set,
are copies of each other and link to nothing else; repeated rows are copies;
rows that repeat a doc_id with different texts are different documents, and a
null doc_id comes last in a class (its class_id is null if no row has an id);
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm import common
from tracklake.llm.components import connected_components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
TARGET_RECALL = 0.999
#: Minhash coordinates of a set; one byte of each goes into the sketch that filters pairs.
COORDINATES = 128
#: Buckets of up to so many sets are compared by brute force.
SMALL_BUCKET = 64
#: Levels of splitting; larger buckets at the last level are compared in blocks.
LEVELS = 3
#: Estimated similarity that a sketch must show: four standard deviations under the threshold.
SKETCH_SIMILARITY = SIMILARITY - 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)
#: Rows of a block in brute force over sketches, and over full sets.
SKETCH_BLOCK, BLOCK = 4096, 256
#: Shared shingles that are multiplied at a time.
SLICE = 8192
MOST_WORDS = 250_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.RandomState(12345).randint(1, 2**62, COORDINATES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.RandomState(54321).randint(1, 2**62, COORDINATES, dtype=np.int64).astype(np.uint64)


def runs_for(recall: float, levels: int) -> int:
    """Runs after which a pair at the threshold is found with probability ``recall``, if it needs all levels."""
    found = 1.0
    for _ in range(levels):
        found = 1 - math.exp(-found)
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


# -- sets


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; words' hashes are remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            pass
        if len(known) > MOST_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.uint64)
        h = self._hashes(words)
        n = min(SHINGLE_WORDS, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES minima, each under a hash of its own; their upper halves."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = shingles[at : at + 4096, None] * _FACTORS + _SHIFTS
        x ^= x >> np.uint64(32)
        np.minimum(out, x.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def text_key() -> Column:
    """A hash that names a text."""
    return F.unhex(F.md5(common.text_or_empty()))


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set_key, size, minima of every row; minima are empty for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(1).to_pylist()
                sets = [shingler.shingles(t) for t in texts]
                minima = [minhash(s).tobytes() if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        pa.array([set_key(s) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(minima, pa.binary()),
                    ],
                    ["doc_id", "text_key", "set_key", "size", "minima"],
                )

    shown = docs.select(F.col("doc_id").cast("bigint"), common.text_or_empty().alias("text"), text_key().alias("text_key"))
    return shown.mapInArrow(run, "doc_id bigint, text_key binary, set_key binary, size int, minima binary")


# -- the trees


def _sampled(node: np.ndarray, coordinate: int, rate: float) -> np.ndarray:
    """Whether each node samples a coordinate: a hash of both, so all its sets agree."""
    x = (node ^ np.uint64(coordinate * 0x632BE59BD9B4E019 % 2**64)) * _MIX
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x < np.uint64(int(rate * 2**64))


def _children(nodes: np.ndarray, minima: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for each sampled coordinate of each (node, set)."""
    rows, children = [], []
    for c in range(COORDINATES):
        at = np.flatnonzero(_sampled(nodes, c, rate))
        if len(at):
            child = (nodes[at] * np.uint64(0x94D049BB133111EB) ^ minima[at, c]) * _MIX + np.uint64(c)
            rows.append(at)
            children.append(child ^ (child >> np.uint64(30)))
    return (np.concatenate(rows), np.concatenate(children)) if rows else (np.zeros(0, int), np.zeros(0, np.uint64))


def _split(sets: DataFrame, node: Column | None, runs: int) -> DataFrame:
    """rep, node (a child) of every set for every sampled coordinate, of the roots of all runs or of ``node``."""
    rate, from_roots = 1 / (SIMILARITY * COORDINATES), node is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                reps = np.asarray(batch.column(0))
                raw = b"".join(batch.column(1).to_pylist())
                minima = np.frombuffer(raw, "<u4").reshape(len(reps), COORDINATES).astype(np.uint64)
                if from_roots:
                    found = []
                    for r in range(runs):
                        root = np.full(len(reps), xxhash.xxh3_64_intdigest(b"root%d" % r), np.uint64)
                        found.append(_children(root, minima, rate))
                    rows, children = (np.concatenate(x) for x in zip(*found, strict=True))
                else:
                    nodes = np.asarray(batch.column(2)).view(np.uint64)
                    rows, children = _children(nodes, minima, rate)
                yield pa.RecordBatch.from_arrays([pa.array(reps[rows]), pa.array(children.view(np.int64))], ["rep", "node"])

    columns = ["rep", "minima"] + ([node] if node is not None else [])
    return sets.select(*columns).mapInArrow(run, "rep bigint, node bigint")


def _forest(groups: np.ndarray, sketches: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """For each connected set of similar sketches in a group, edges from its smallest id to the others.

    Rows of one group stand together. A group is done as soon as it is one
    connected set, which for near copies is after few comparisons.
    """
    least, n = SKETCH_SIMILARITY * COORDINATES, len(ids)
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff([*first, n])
    own = np.repeat(np.arange(len(first)), sizes)
    ends = np.repeat(first + sizes, sizes)
    parts = sizes.copy()  # connected sets of each group
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = parent.get(up, up)
            i = up
        return i

    rows = np.arange(n)
    for apart in range(1, int(sizes.max(initial=1))):
        rows = rows[(rows + apart < ends[rows]) & (parts[own[rows]] > 1)]
        if not len(rows):
            break
        for lo in range(0, len(rows), 8192):
            left = rows[lo : lo + 8192]
            agree = (sketches[left] == sketches[left + apart]).sum(axis=1)
            for i in left[agree >= least].tolist():
                a, b = root(i), root(i + apart)
                if a != b:
                    parent[b] = a
                    parts[own[i]] -= 1
    members: dict[int, list[int]] = {}
    for i in parent:
        members.setdefault(root(i), []).append(int(ids[i]))
    edges = []
    for top, others in members.items():
        found = sorted({int(ids[top]), *others})
        edges += [(found[0], x) for x in found[1:]]
    return edges


def aligned(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 8192) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or one group; the first ``keys`` columns name a group, whose rows come together."""
    held: list[pa.RecordBatch] = []
    count = 0

    def joined() -> tuple[pa.Table, int]:
        table = pa.Table.from_batches(held).combine_chunks()
        names = [table.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(len(table), bool)
        for v in names:
            change[1:] |= v[1:] != v[:-1]
        last = np.flatnonzero(change)
        return table, int(last[-1]) if len(last) else 0

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table, cut = joined()
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                count = len(table) - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def candidate_edges(sets: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """a, b: spanning forests of similar sets over all buckets. ``sets``: rep, minima."""
    runs = runs_for(recall, LEVELS)
    members = common.materialize(_split(sets, None, runs), "level")
    small = []
    for level in range(1, LEVELS + 1):
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = common.materialize(members.join(sizes.hint("merge"), "node"), "buckets")
        if level == LEVELS:
            small.append(sized)
            break
        small.append(sized.where(F.col("n") <= SMALL_BUCKET))
        large = sized.where(F.col("n") > SMALL_BUCKET)
        if large.isEmpty():
            break
        joined = large.select("rep", "node").join(sets.hint("merge"), "rep")
        members = common.materialize(_split(joined, F.col("node"), runs), "level")
    buckets = small[0]
    for more in small[1:]:
        buckets = buckets.union(more)
    return _bucket_edges(buckets, sets)


def _bucket_edges(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Brute force in buckets as they are; buckets beyond SKETCH_BLOCK sets are dealt to pairs of blocks."""
    spark = buckets.sparkSession
    parts = F.ceil(F.col("n") / SKETCH_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    dealt = buckets.select("rep", "node", parts.alias("parts"), own.alias("own"))
    # A row meets every other block of its bucket once: block pairs (own, k).
    pairs = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = pairs.select("rep", "node", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))
    sketch = common.materialize(_sketches(sets), "sketches")
    rows = keyed.join(sketch.hint("merge"), "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in aligned(batches, 3):
            node, i, j, ids = (table.column(k).to_numpy() for k in range(4))
            groups = np.cumsum(np.concatenate([[True], (node[1:] != node[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            sketches = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint8).reshape(len(ids), COORDINATES)
            edges = _forest(groups, sketches, ids)
            a, b = zip(*edges, strict=True) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("node", "i", "j", "rep", "sketch").repartition(n, "node", "i", "j").sortWithinPartitions("node", "i", "j")
    return placed.mapInArrow(compare, "a bigint, b bigint").distinct()


def grouped(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows that are sorted by ``keys``, over the borders of batches; many small groups cost one call each at most."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch), bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change).tolist()
        if rest and any(rest[-1][k].iloc[-1] != v[0] for k, v in zip(keys, values, strict=True)):
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        begin = 0
        for end in starts:
            part = batch.iloc[begin:end]
            yield pd.concat([*rest, part]) if rest else part
            rest, begin = [], end
        rest.append(batch.iloc[begin:])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def _sketches(sets: DataFrame) -> DataFrame:
    """rep, sketch: the lowest byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8)
            rows = np.ascontiguousarray(minima[::4]).tobytes()
            sketches = [rows[i : i + COORDINATES] for i in range(0, len(rows), COORDINATES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches, pa.binary())], ["rep", "sketch"])

    return sets.select("rep", "minima").mapInArrow(run, "rep bigint, sketch binary")


# -- exact comparison


def _links(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Whether each set of ``left`` links to each of ``right`` (or of itself): a boolean matrix."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], float)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n = len(left)
    other = slice(n, len(sets)) if right is not None else slice(0, n)
    both = np.zeros((n, len(sets) - n if right is not None else n), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, SLICE):
        a, b = np.searchsorted(column, [lo, lo + SLICE])
        m = np.zeros((len(sets), min(SLICE, width - lo)), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        both += m[:n] @ m[other].T
    union = sizes[:n, None] + sizes[None, other] - both
    return both >= SIMILARITY * union - 1e-9


def _compare_blocks(rows: DataFrame) -> DataFrame:
    """rep, other, links from rows (grp, i, j, side, rep, texts, shingles).

    One row for each set: the weight of its links found in this pair of blocks,
    and one spanning edge or null.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in grouped(batches, ["grp", "i", "j"]):
            batch = batch.sort_values("rep")
            ids, texts = batch["rep"].to_numpy(), batch["texts"].to_numpy().astype(np.int64)
            sets = [np.frombuffer(s, "<u8") for s in batch["shingles"]]
            side = batch["side"].to_numpy()
            diagonal = batch["i"].iloc[0] == batch["j"].iloc[0]
            if diagonal:
                left = right = np.arange(len(ids))
                linked = _links(sets, None)
                np.fill_diagonal(linked, False)
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                if not len(left) or not len(right):
                    continue
                linked = _links([sets[k] for k in left], [sets[k] for k in right])
            out = {int(r): 0 for r in ids}
            for r, n in zip(ids[left].tolist(), (linked @ texts[right]).tolist(), strict=True):
                out[r] += n
            if not diagonal:
                for r, n in zip(ids[right].tolist(), (linked.T @ texts[left]).tolist(), strict=True):
                    out[r] += n
            # a spanning forest over the linked sets
            parent = {int(r): int(r) for r in ids}

            def root(x: int, parent: dict[int, int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            edges = []
            for k in range(len(left)):
                for m in np.flatnonzero(linked[k]).tolist():
                    a, b = root(int(ids[left[k]])), root(int(ids[right[m]]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        edges.append((int(ids[left[k]]), int(ids[right[m]]), 0))
            found = [(r, None, n) for r, n in out.items() if n] + edges
            if found:
                frame = pd.DataFrame(found, columns=["rep", "other", "links"])
                frame["other"] = frame["other"].astype("Int64")
                yield frame

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(n, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return placed.mapInPandas(compare, "rep bigint, other bigint, links bigint")


def _shingles_of(docs: DataFrame) -> DataFrame:
    """set_key, shingles (sorted, little-endian) of a few rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingler.shingles(t) for t in batch.column(1).to_pylist()]
                keys, raw = [set_key(s) for s in sets], [s.astype("<u8").tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["set_key", "shingles"])

    return docs.mapInArrow(run, "set_key binary, shingles binary")


def similarity_classes(docs: DataFrame, recall: float = TARGET_RECALL, keyed: bool = False) -> DataFrame:
    """doc_id, class_id, class_size, n_links, is_first (and the text's key) of every row.

    ``class_id`` is the smallest doc_id of the documents connected by links (a
    Jaccard index of at least 0.8) or by equal sets; ``n_links`` the number of
    other different texts that the document's text links to; ``is_first`` holds
    for the one document of the class that has the smallest doc_id and, among
    such rows, the smallest ``text_key``; rows that repeat both share it.
    """
    rows = common.materialize(_sets(docs), "sets")
    # A set is numbered, and remembers one document that has it; hot sets are combined on the map side first.
    by_text = rows.groupBy("set_key", "text_key").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("minima").alias("minima"))
    sets = by_text.groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("texts"), F.first("size").alias("size"), F.first("minima").alias("minima")
    )
    sets = common.materialize(sets.withColumn("rep", F.monotonically_increasing_id()), "distinct-sets")
    edges = common.materialize(candidate_edges(sets.where("size > 0").select("rep", "minima"), recall), "candidates")
    groups = connected_components(edges)  # node, label: candidate groups
    links, final = _exact(docs, sets, groups)
    reps = sets.select("set_key", "rep", "texts")
    reps = (
        reps.join(links.hint("merge"), "rep", "left")
        .join(final.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
        .select(
            "set_key",
            F.coalesce("label", "rep").alias("label"),
            (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("n_links"),
        )
    )
    reps = common.materialize(reps, "set-classes")
    placed = rows.select("doc_id", "text_key", "set_key").join(reps.hint("merge"), "set_key").drop("set_key")
    placed = common.materialize(placed, "doc-classes")
    # The first row of a class is found in two steps, each of which adds up numbers on the map side.
    known = F.col("doc_id").isNotNull()
    texts = placed.groupBy("label", "doc_id").agg(F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(~known, "doc_id", "text_key")).alias("first")
    sizes = common.materialize(texts.groupBy("label").agg(first, F.sum("n").alias("class_size")), "class-sizes")
    return placed.join(sizes.hint("merge"), "label").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_links",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("is_first"),
        *(["text_key"] if keyed else []),
    )


def _exact(docs: DataFrame, sets: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of each representative, and the components of the exact links."""
    named = groups.select(F.col("node").alias("rep"), F.col("label").alias("grp"))
    chosen = common.materialize(named.join(sets.select("rep", "texts", "set_key", "doc_id").hint("merge"), "rep"), "members")
    ids = common.materialize(chosen.where("doc_id is not null").select("doc_id").distinct(), "member-ids")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_or_empty().alias("text"))
    held = common.only_ids(texts, ids, "doc_id")
    if not chosen.where("doc_id is null").isEmpty():  # sets of rows without an id alone
        held = held.union(texts.where("doc_id is null"))
    found = _shingles_of(held.select("doc_id", "text")).join(chosen.select("set_key", "rep").hint("merge"), "set_key")
    shingles = common.materialize(found.groupBy("rep").agg(F.first("shingles").alias("shingles")), "member-sets")
    members = common.materialize(_with_core(chosen, shingles), "core-sets")
    core = F.col("core").cast("int")
    sizes = members.groupBy("grp").agg(
        F.sum(1 - core).alias("loose"), F.sum(core).alias("tight"), F.sum(F.col("texts") * core).alias("core_texts"), F.max("leader").alias("leader")
    )
    members = common.materialize(members.drop("leader").join(sizes.hint("merge"), "grp"), "sized-members")
    # Sets outside a core are compared with each other in blocks, each pair of blocks once, ...
    parts = F.ceil(F.col("loose") / BLOCK).cast("int")
    loose = members.where("not core").select("rep", "texts", "grp", parts.alias("parts"), F.pmod(F.xxhash64("rep"), parts).cast("int").alias("own"))
    pairs = loose.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = pairs.select(
        "rep", "texts", "grp", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") > F.col("k")).cast("int").alias("side")
    )
    # ... and with the core's; blocks of the core have negative numbers.
    other = F.ceil(F.col("tight") / BLOCK).cast("int")
    crossed = members.where("loose > 0 and tight > 0").select("rep", "texts", "grp", "core", parts.alias("parts"), other.alias("other"))
    crossed = crossed.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("core"), F.col("other")).otherwise(F.col("parts"))).cast("int"))
    crossed = crossed.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("core"), F.col("parts")).otherwise(F.col("other")) - 1)))
    i, j = F.when(F.col("core"), F.col("k")).otherwise(F.col("own")), F.when(F.col("core"), F.col("own")).otherwise(F.col("k"))
    keyed = keyed.union(crossed.select("rep", "texts", "grp", i.alias("i"), (-1 - j).alias("j"), F.col("core").cast("int").alias("side")))
    found = common.materialize(_compare_blocks(keyed.join(shingles.hint("merge"), "rep")), "links")
    # Sets of a core link to each other without being compared.
    tight = members.where("core").select("rep", "leader", (F.col("core_texts") - F.col("texts")).alias("links"))
    links = found.where("other is null").select("rep", "links").union(tight.select("rep", "links")).groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select("rep", "other").union(tight.select("rep", "leader"))
    return common.materialize(links, "link-counts"), connected_components(edges, "rep", "other")


def _with_core(chosen: DataFrame, shingles: DataFrame) -> DataFrame:
    """``chosen`` with leader and core: whether a set belongs to the core of a group of more than BLOCK sets.

    The Jaccard distance is a metric, so any two sets within half of the limit
    of one set, the group's leader, are within the limit of each other: a
    large group of close copies needs as many comparisons as it has sets.
    """
    sizes = chosen.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader"))
    sized = common.materialize(chosen.select("rep", "texts", "grp").join(sizes.hint("merge"), "grp"), "group-sizes")
    large = sized.where(F.col("n") > BLOCK)
    shown = sized.select("rep", "texts", "grp", F.lit(None).cast("bigint").alias("leader"), F.lit(False).alias("core"))
    if large.isEmpty():
        return shown
    leaders = large.select("leader").distinct().join(shingles.select(F.col("rep").alias("leader"), F.col("shingles").alias("first")).hint("merge"), "leader")
    leaders = common.materialize(leaders, "leader-sets")
    both = common.materialize(large.select("rep", "leader").join(shingles.hint("merge"), "rep"), "large-groups").join(leaders.hint("merge"), "leader")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a, b = np.frombuffer(own, "<u8"), np.frombuffer(first, "<u8")
                shared = len(np.intersect1d(a, b, assume_unique=True))
                # A little stricter than half of the limit, against rounding.
                out.append(shared >= (1 - (1 - SIMILARITY) / 2 + 1e-9) * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_())], ["rep", "is_core"])

    measured = common.materialize(both.select("rep", "shingles", "first").mapInArrow(measure, "rep bigint, is_core boolean"), "core-distances")
    joined = sized.join(measured.hint("merge"), "rep", "left")
    return joined.select("rep", "texts", "grp", F.when(F.col("n") > BLOCK, F.col("leader")).alias("leader"), F.coalesce("is_core", F.lit(False)).alias("core"))


#: Every pair of texts with a common shingle, and components by recursion: for small tables.
ORACLE = r"""
    with recursive
    d as (select doc_id, coalesce(text, '') as text from documents),
    t as (select text, min(doc_id) as rep from d group by text),
    w as (select rep, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from t),
    s as (
      select distinct rep, unnest(case
        when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g
      from w),
    n as (select rep, count(*) as n from s group by rep),
    p as (select a.rep as a, b.rep as b, count(*) as c from s a join s b on a.g = b.g and a.rep < b.rep group by all),
    l as (
      select a, b from p join n x on x.rep = a join n y on y.rep = b
      where c >= 0.8 * (x.n + y.n - c) - 1e-9),
    e as (select a, b from l union all select b, a from l),
    r(node, label) as (select rep, rep from t union select e.b, r.label from r join e on e.a = r.node),
    c as (select node, min(label) as class_id from r group by node),
    k as (select a as node, count(*) as n_links from e group by a)
    select doc_id, class_id, count(*) over (partition by class_id) as class_size, coalesce(n_links, 0) as n_links,
           doc_id = class_id as is_first
    from d join t using (text) join c on c.node = t.rep left join k on k.node = t.rep"""
