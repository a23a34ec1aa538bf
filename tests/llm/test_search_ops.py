"""Spelling variants and ranked search against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from tracklake.llm import spelling, wand

DOCS = "doc_id bigint, text string, word string, query int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1) for i, t in rows], DOCS)


def brute_vocabulary(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] == 1


def brute_variants(words):
    near = {w: [x for x in words if distance_is_one(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words[form[w]] if form[w] else -1) for w in words)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def misspelled(rng, word, letters):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:at] + (rng.choice(letters) if kind else "") + word[at + (kind < 2) :]


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnéÿ÷"])
@pytest.mark.parametrize("block", [spelling.BLOCK, 3])
def test_variants_equal_brute_force(spark, letters, block):
    rng = random.Random(len(letters))
    words = {"".join(rng.choices(letters, k=rng.randint(5, 9))): rng.randint(3, 60) for _ in range(60)}
    for w in list(words):
        for _ in range(5):
            w = misspelled(rng, w, letters)
            if len(w) >= 5:
                words.setdefault(w, rng.randint(3, 60))
    words |= {"a" * n: 3 * 4 ** (n - 5) for n in range(5, 16)}  # a long chain of forms, and grams that repeat
    given = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(5)
    assert rows_of(spelling.variants(given, block)) == brute_variants(words)


def test_vocabulary_equals_brute_force(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choices("aBcDÉéx", k=rng.randint(1, 8))) for _ in range(40)]
    rows = [(i, rng.choice([" ", "9", "-", "Ā"]).join(rng.choices(pool, k=40))) for i in range(120)]
    rows += [(None, "Missing missing MISSING"), (3, None), (4, ""), (5, "repeated"), (5, "repeated"), (5, "Repeated"), (6, "z" * 70_000)]
    found = spelling.vocabulary(frame(spark, rows))
    want = brute_vocabulary(rows)
    assert {r.word: r.n for r in found.collect()} == want and "missing" in want and "repeated" in want
    assert rows_of(spelling.variants(found)) == brute_variants(want)
    assert spelling.variants(spelling.vocabulary(frame(spark, []))).collect() == []


def test_one_edit():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == distance_is_one(a, b)


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(rows, queries, k=10):
    words = [["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(x or "")] for _, x in rows]
    n_docs, n_terms = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    counts = [Counter(w) for w in words]
    out = []
    for item, text in queries:
        own = {"".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")}
        found = []
        for (i, _), tf, w in zip(rows, counts, words, strict=True):
            score = 0
            for t in own & set(tf):
                m = 10 + 90 * len(w) * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def found_rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("shard_postings", [1, 150, wand.SHARD_POSTINGS])
def test_search_equals_brute_force(spark, shard_postings):
    rng = random.Random(6)
    pool = [f"{rng.choice('aQÉ漢')}{i}" for i in range(60)]
    share = [1 / (i + 1) for i in range(60)]
    rows = [(i, rng.choice([" ", "\n", "_", "\x7f"]).join(rng.choices(pool, share, k=rng.randint(1, 50)))) for i in range(150)]
    rows += [(700 + i, rows[3][1]) for i in range(30)]  # ties at the end of the list
    rows += [(None, rows[3][1]), (2, rows[3][1]), (2, rows[3][1]), (900, None), (901, ""), (902, " .\n"), (903, "a0 " * 20_000)]
    queries = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(25)]
    queries += [(30, rows[3][1]), (31, None), (32, "absent"), (33, "absent " + pool[0].lower()), (None, pool[7]), (30, pool[50]), (34, "!!")]
    items = spark.createDataFrame([(i, t, 0) for i, t in queries], "item_id bigint, text string, score int")
    found = wand.search(frame(spark, rows).repartition(3), items, shard_postings=shard_postings)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert found_rows(found) == brute_search(rows, queries)


def test_search_in_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(wand, "BLOCK_QUERIES", 2)
    rows = [(i, f"w{i % 5} w{i % 3} v{i}") for i in range(40)]
    queries = [(i, f"w{i} v{3 * i}") for i in range(5)]
    items = spark.createDataFrame(queries, "item_id int, text string")
    assert found_rows(wand.search(frame(spark, rows), items)) == brute_search(rows, queries)
    assert wand.search(frame(spark, []), items).collect() == [] and wand.search(frame(spark, rows), items.limit(0)).collect() == []


def test_wand_skips_documents():
    """A common term alone can't beat the heap, so most of its postings are never scored."""
    import numpy as np

    n = 20_000
    rare = np.arange(0, n, 500)
    counts = np.ones(n, int)
    counts[rare] = 2
    term = np.concatenate([[0, 1] if c == 2 else [0] for c in counts])
    shard = wand.Shard(np.arange(n), np.full(n, 10), counts, term, np.ones(len(term), int), np.array([10, 9000]), n, 10 * n)
    shard.of(0), shard.of(1)
    reads = []

    class Counted(type(shard.lists[0][1])):
        def __getitem__(self, i):
            reads.append(i)
            return super().__getitem__(i)

    for t in (0, 1):
        docs, shares, most = shard.lists[t]
        shard.lists[t] = docs, Counted("q", shares), most
    assert [p for _, p in shard.search([0, 1], 10)] == list(rare[:10]) and len(reads) < 600
