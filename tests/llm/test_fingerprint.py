"""Fingerprints against a plain version, and their collision rate against the similarity they stand for."""

import hashlib
import math
import random
from collections import Counter

import pytest
import regex
import xxhash

from tracklake.llm import entry, fingerprint


def signed(n):
    return n - 2**64 if n >= 2**63 else n


def xx(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, 42)


def brute_marks(text, samples):
    words = regex.findall(fingerprint.WORD, text.lower()) or [text]
    weights = Counter(xx(w.encode()) for w in words)

    def uniform(bits, n):
        return ((bits >> (21 * n) & (1 << 21) - 1) + 0.5) * 2.0**-21

    marks = []
    for k in range(samples):
        least = math.inf
        for term, s in weights.items():
            draws, more = (xx(((term ^ n) & 2**64 - 1).to_bytes(8, "little")) for n in (2 * k, 2 * k + 1))
            c, u2, u1 = -math.log(uniform(draws, 0) * uniform(draws, 1)), uniform(draws, 2), uniform(more, 0)
            r = -math.log(u1 * u2)
            e1 = -math.log(u1)
            t = math.floor(math.log(s) / r + e1 / r)
            # the published form: y = exp(r (t - b)), a = c / (y exp(r)), with b = e1 / r
            a = c / (math.exp(r * (t - e1 / r)) * math.exp(r))
            least = min(least, a)
        marks.append(least)
    return marks


def brute_rows(rows, samples=fingerprint.SAMPLES):
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, x[0] or 0, signed(xx(x[1].encode()))))
    out = []
    for at, (i, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = (brute_marks(t, samples) for t in (text, edited, following))
        like = lambda a, b: sum(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b, strict=True)) / samples
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(own, other), like(own, after)))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdé漢", k=rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(60)]
    texts += [None, "", " \n", "!!", "x", "😀y", texts[3], texts[3], "word " * 3000]
    rows = [(7 * i % 1000, t) for i, t in enumerate(texts)] + [(None, "without id"), (None, texts[5]), (14, "same id"), (14, "same id"), (14, "other")]
    docs = spark.createDataFrame([(i, t, "k", "r") for i, t in rows], "doc_id bigint, text string, key string, range string")
    found = fingerprint.fingerprint(docs)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = found.collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key) == sorted(brute_rows(rows), key=key)
    assert all(len(r.fingerprint) == len(r.edited_fingerprint) == 8 * fingerprint.SAMPLES for r in got)
    by_id = {r.doc_id: r for r in got}
    same = [r.fingerprint for r in got if r.doc_id in (7 * 3, 7 * 66, 7 * 67)]
    assert len(set(same)) == 1 and by_id[7 * 66].near_next == 1 and by_id[7 * 66].near_edited < 1


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(5, "a b c d")], "doc_id int, text string")
    (row,) = fingerprint.fingerprint(docs).collect()
    assert row.near_next == 1 and row.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    assert fingerprint.fingerprint(docs.limit(0)).collect() == []


def test_ranges_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.randrange(-40, 40), " ".join(rng.choices("abcdefg", k=9))) for _ in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(tuple, fingerprint.fingerprint(docs, samples=4).collect()))
    for ranges in (1, 25):
        monkeypatch.setattr(fingerprint, "RANGES_PER_PARTITION", ranges)
        assert sorted(map(tuple, fingerprint.fingerprint(docs, samples=4).collect())) == want


@pytest.mark.parametrize("weights", [([1, 1, 1, 1], [1, 1, 1, 1]), ([3, 1, 2, 9], [1, 2, 2, 9]), ([5, 5, 0, 0], [0, 5, 5, 5]), ([1, 0, 0, 7], [8, 1, 1, 1])])
def test_collisions_are_the_generalised_jaccard_similarity(spark, weights):
    """Over many pairs of texts whose words differ and whose counts are the same."""
    first, second = weights
    rows = []
    for i in range(120):
        for j, counts in enumerate((first, second)):
            rows.append((2 * i + j, " ".join(f"t{i}x{k}" for k, n in enumerate(counts) for _ in range(n))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", fingerprint.terms_of("text").alias("terms"))
    marks = {r.doc_id: r.marks for r in fingerprint.fingerprints(docs, ["doc_id"]).collect()}
    share = sum(x == y for i in range(120) for x, y in zip(marks[2 * i], marks[2 * i + 1], strict=True)) / (120 * fingerprint.SAMPLES)
    want = sum(map(min, first, second)) / sum(map(max, first, second))
    assert abs(share - want) < 4 * math.sqrt(want * (1 - want) / (120 * fingerprint.SAMPLES)) + 1e-12


def test_query_has_no_python(spark):
    df = entry.queries()["op11_fingerprint"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
