"""Packing, exact dedup, licence scan, line dedup, URL filter, BPE: against brute force and on odd input."""

import hashlib
import os
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracklake.llm import bpe, byte_bpe, common, exact_dedup, license_scan, license_texts, line_dedup, packing, url_filter

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    None, "", "   ", "\n\n", "a", "Same text.", "Same  text.", "same text.", "x" * 3000, "word " * 20000, "<|endoftext|> <|startoftext|>",
    "naïve Ça Ünïcode ñ 日本語 🙂 \u200b\u00ad ﷺ İ ΑΣ", "tab\tand\r\nline", "it's I'LL 123 !!", "\x1c\x85\xa0 x", "Licensed under CC BY-NC 4.0.",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(100, "Same text.", "clash"), (0, None, "clash")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, length string")


# -- packing


def test_fill_window_is_best():
    rng = random.Random(1)
    for _ in range(60):
        counts = dict(Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 9))))
        chosen = packing.fill_window(counts, 40)
        assert all(n <= counts[k] for k, n in chosen.items()) and max(counts) in chosen
        items = list(Counter(counts).elements())
        items.remove(max(counts))
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        assert sum(k * n for k, n in chosen.items()) == max(s + max(counts) for s in sums if s + max(counts) <= 40)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_length_once(histogram):
    windows = defaultdict(list)
    for length, first, end, copies, sequence, offset in packing.plan_windows(histogram, 64):
        for rank in range(first, end):
            at = rank - first
            windows[sequence + at // copies].append((offset + at % copies * length, length))
    assert Counter(n for w in windows.values() for _, n in w) == Counter(histogram)
    for w in windows.values():
        end = 0
        for offset, length in sorted(w):
            assert offset == end
            end += length
        assert end <= 64


def test_pack_round_trip(spark, docs):
    rows = packing.pack(docs, BYTES, with_ids=True).collect()
    library = Tokenizer.from_file(BYTES)
    want = Counter()
    for r in docs.collect():
        want[(r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 1]))] += 1
    parts = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        parts[r.doc_id].append((r.start, tuple(ids.tolist())))
    for (doc, ids), n in want.items():
        joined = [i for _, p in sorted(set(parts[doc])) for i in p]
        assert tuple(joined) == ids and len(parts[doc]) == n * len(set(parts[doc]))
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for span in spans.values():
        end = 0
        for offset, length in sorted(span):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert packing.pack(docs.limit(0), BYTES).count() == 0


def test_little_padding(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["a", "bc", "def", "ghij"], k=rng.randint(1, 900)))) for i in range(300)]
    sums = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), BYTES).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in sums) / (2048 * len(sums)) > 0.98


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_is_the_librarys(text):
    own = byte_coder()
    want = own.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == want


_CODERS: dict = {}


def byte_coder():
    if "bytes" not in _CODERS:
        _CODERS["bytes"] = byte_bpe.ByteBpe(BYTES)
    return _CODERS["bytes"]


def word_coder():
    if "words" not in _CODERS:
        _CODERS["words"] = bpe.WordBpe(WORDS)
    return _CODERS["words"]


# -- BPE


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdehinorst '.1", max_size=80)))
def test_bpe_is_the_librarys(text):
    own = word_coder()
    ids, decoded = own.encode_batch([text])[0]
    want = own.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded == own.library.decode(want, skip_special_tokens=False)


def test_speculation_fails_and_is_mended():
    table = word_coder().table
    rng = random.Random(3)
    words = ["".join(rng.choices("aehinorst", k=rng.randint(1, 90))) for _ in range(400)]
    found, failed = table.encode_words(words)
    assert 0 < failed < len(words) and found == [table.merge(w) for w in words]
    assert table._merge_long([table.vocab[c] for c in "thethen"]) == table._merge_short([table.vocab[c] for c in "thethen"])


def test_repeats_in_compatibility():
    table = bpe.MergeTable({"a": 0, "a</w>": 1, "aa": 2, "aaaa": 3}, [("a", "a"), ("aa", "aa")], "</w>")
    for n in range(1, 12):
        assert table.encode_words(["a" * n])[0] == [table.merge("a" * n)]


def test_encode_decode_rows(spark, docs):
    library, rows = Tokenizer.from_file(WORDS), bpe.encode_decode(docs, WORDS, with_ids=True).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        raw = np.asarray(want, "<u4").tobytes()
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(want), raw, hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), WORDS).count() == 0


# -- exact dedup


def brute_digests(rows):
    key = {}
    for doc_id, text in rows:
        key.setdefault(hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest(), []).append(doc_id)
    return sorted((d, min(ids), len(ids), d == min(ids), k) for k, ids in key.items() for d in ids)


def test_exact_dedup(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(docs).collect()) == brute_digests(rows)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "x"), (None, "x"), (5, "y"), (None, "y")], "doc_id bigint, text string")
    assert Counter((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(nulls).collect()) == Counter({(None, None, True): 2, (5, 5, True): 1, (None, 5, False): 1})


def test_index_outlives_a_batch(spark):
    path = common.new_path(spark, "test-index")
    first = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id bigint, text string")
    second = spark.createDataFrame([(1, "a  b"), (2, "d"), (3, "d")], "doc_id bigint, text string")
    exact_dedup.dedup_batch(first, exact_dedup.DigestIndex(spark, path, name="index_one"), 0).count()
    again = exact_dedup.DigestIndex(spark, path, name="index_two")  # as another session opens it
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup_batch(second, again, 1).collect())
    assert got == [(1, 5, 1, False), (2, 2, 2, True), (3, 2, 2, False)]
    assert again.rows().count() == 3
    plan = first.select(exact_dedup.digest(F.col("text")).alias("digest")).join(again.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Python" not in plan


# -- licences


def test_licenses(spark):
    mit = license_texts.LICENSES[0][1]
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.upper().replace(",", " ;").replace("\n", "\n\n")), (3, mit + " more"),
        (4, None), (5, "..."), (6, "Some text.\nRELEASED under the mit licence\nLicensed under CC BY-NC 4.0.\nmore"), (7, "x" * 100000),
    ]
    got = {r.doc_id: (r.license, r.notices) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, ""), 5: (None, ""), 6: (None, "CC-BY-NC-4.0,MIT"), 7: (None, "")}


def test_long_lines_are_notices_too(spark):
    mit, apache = license_texts.LICENSES[0][1], license_texts.LICENSES[15][1]
    rows = [
        (1, "A readme.\n" + " ".join(mit.split()) + "\nmore"), (2, "code\n# " + " ".join(apache.split())),
        (3, "x\n" + "*" * 500 + " Released under the MIT License. " + "=" * 500 + "\ny"), (4, "x\n" + " ".join(mit.split()) + " more"),
    ]
    got = {r.doc_id: (r.license, r.notices) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (None, "MIT"), 2: (None, "Apache-2.0"), 3: (None, "MIT"), 4: (None, "")}


def test_published_wrapping(spark):
    """The MIT licence as it is published, in 80 columns, in one line for each paragraph, and in narrow lines."""
    paragraphs = [
        "MIT License", "Copyright (c) 2020 Jane Doe",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ]
    widths = [30, 38, 50, 60, 72, 78, 80, 100, 130, 100_000]
    texts = ["\n\n".join(textwrap.fill(p, w) for p in paragraphs) for w in widths]
    texts += ["\n".join(" * " + x for x in texts[6].split("\n")), texts[6].replace("(c) 2020", "2019-2021"), texts[6].replace("\n", "\r\n")]
    assert any(x.startswith("COPYRIGHT HOLDERS") for t in texts for x in t.split("\n"))
    rows = [*enumerate(texts), (99, texts[6].replace("free of charge", "for a fee"))]
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {**dict.fromkeys(range(len(texts)), "MIT"), 99: None}


HOLDERS = [
    "Copyright (c) 2020 " + "Jane Doe, " * 60, "Copyright " + "Jane Doe, " * 60 + "2020", "Copyright Jane Doe", "Copyright The Go Authors.",
    "copyright by Jane Doe <jane@example.com>", "Portions Copyright (c) 2020 Jane Doe", "PORTIONS COPYRIGHT 2020 JANE DOE", "# © Jane Doe", "Copyright Élan Vital and contributors",
]
NO_HOLDERS = ["Copyright Holders may use it freely.", "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "Copyright Holder", "copyright and Related Rights", "portions of it"]


@pytest.mark.parametrize("line", [*HOLDERS, *NO_HOLDERS])
def test_holder_lines(line):
    assert (license_scan.canonical_text(f"one\n{line}\ntwo") == "one two") == (line in HOLDERS)


def test_forms_of_texts_from_lines(spark):
    """A text's form from those of its lines equals that of the whole text, and licences under any holder line are found."""
    mit = license_texts.LICENSES[0][1]
    rows = [(i, f"MIT License\n\n{line}\n\n{mit}" if "MIT License" not in mit else f"{line}\n{mit}") for i, line in enumerate(HOLDERS)]
    odd = ["", "\n", "sub\nlicence", "non\n\n-commercial third\nparties", "copyright\nowner whil\nst", "Copyright A B\r\nx\n", "per\ncent per\ncent", "x" * 70000 + "\nY"]
    df = spark.createDataFrame([(i, t) for i, t in rows + list(enumerate(odd, 100))], "doc_id bigint, text string")
    lines = F.transform(F.split("text", "\n"), license_scan.canonical)
    for r in df.select("text", license_scan.canonical(F.col("text")).alias("whole"), license_scan.canonical_of_lines(lines).alias("joined")).collect():
        assert r.whole == r.joined == license_scan.canonical_text(r.text)
    got = {r.doc_id: r.license for r in license_scan.scan(df).collect()}
    assert all(got[i] == "MIT" for i, _ in rows)


def test_full_license_texts(spark):
    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("the texts are not on this machine")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {f: open(f"{folder}/{f}", encoding="utf-8").read() for f in names}
    rows = [(f, t) for f, t in texts.items()] + [(f + " in one line", "x\n" + " ".join(t.split())) for f, t in texts.items()]
    got = {r.doc_id: r.license or r.notices for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {**names, **{f + " in one line": n for f, n in names.items()}}


def test_canonical_is_the_same_in_both_languages(spark):
    rows = [(i, text) for i, (_, text) in enumerate(license_texts.LICENSES)] + [(99, "“Smart” — licence\n© me\nOrganisation's")]
    df = spark.createDataFrame(rows, "i int, text string").select("text", license_scan.canonical(F.col("text")).alias("c"))
    assert all(r.c == license_scan.canonical_text(r.text) for r in df.collect())


# -- lines


def brute_lines(rows):
    """Kept positions by document, comparing every pair of lines."""

    def norm(x):
        return re.sub(r"[!-/:-@\[-`{-~\s]+", " ", x.lower()).strip(" ")

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    lines = [(d, p, norm(x)) for d, t in rows for p, x in enumerate((t or "").split("\n"))]
    return lines, edit


def test_line_dedup(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    long = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts = []
    for i in range(30):
        base = rng.choice(long).split()
        if rng.random() < 0.6:
            base[rng.randrange(60)] = word()
        texts.append("\n".join([" ".join(base), rng.choice(["Short line!", "short, line", "", "***", word()]), " ".join(word() for _ in range(5))]))
    rows = [*enumerate(texts), (50, None), (51, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    decided = line_dedup.line_decisions(df).collect()
    lines, edit = brute_lines(rows)
    sims = {(r.doc_id, r.pos): r.sim for r in line_dedup._simhashes(line_dedup._lines(df)).collect()}
    worded = [x for x in lines if x[2]]
    parent = list(range(len(worded)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = 0
    for i, (d, p, x) in enumerate(worded):
        for j, (e, q, y) in enumerate(worded[:i]):
            bits = bin((sims[d, p] ^ sims[e, q]) & (2**64 - 1)).count("1")
            if x == y or (bits <= 3 and edit(x, y) <= 0.2 * max(len(x), len(y))):
                parent[root(i)] = root(j)
                linked += x != y
    first = {}
    for i, (d, p, _) in enumerate(worded):
        first[root(i)] = min((d, p), first.get(root(i), (d, p)))
    want = {(d, p): first[root(i)] == (d, p) for i, (d, p, _) in enumerate(worded)}
    assert {(r.doc_id, r.pos): r.kept for r in decided} == want and linked > 20
    by_doc = line_dedup.line_dedup(df)
    got = {r.doc_id: r for r in by_doc.collect()}
    assert len(got) == len(rows) and (got[50].n_lines, got[50].n_kept) == (1, 1)
    clean = {r.doc_id: r.text for r in line_dedup.without_lines(df, by_doc).collect()}
    for d, t in rows:
        kept = [x for p, x in enumerate((t or "").split("\n")) if want.get((d, p), True)]
        assert clean[d] == (None if t is None else "\n".join(kept))
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_lines_near_by_edits_alone(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 7)))
    lines, pairs = [], []
    for words, changes in [(4, 0), (6, 1), (10, 1), (15, 2), (20, 2), (40, 1), (40, 4), (60, 6)]:
        for _ in range(10):
            base = [word() for _ in range(words)]
            own = list(base)
            for at in rng.sample(range(words), changes):
                own[at] = word()
            if not changes:
                own[1] = own[1][:-1]  # a character less
            pairs.append((len(lines), len(lines) + 1))
            lines += [" ".join(base), " ".join(own)]
    rows = list(enumerate(lines)) + [(1000, "nitwit"), (1001, "nitwits"), (1002, "Nit-wit"), (1003, None)]
    _, edit = brute_lines([])
    near = {b for a, b in pairs if edit(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b]))}
    decided = line_dedup.line_decisions(spark.createDataFrame(rows, "doc_id bigint, text string"), by_edits=True)
    gone = {r.doc_id for r in decided.collect() if not r.kept}
    assert len(near) > 60 and gone <= near | {1001, 1002}
    assert len(gone & near) >= 0.97 * len(near) and 1001 in gone


def brute_simhash(norm, hashes):
    """Majority votes of the distinct words' hashes, bit by bit."""
    words = [hashes[w] for w in set(norm.split(" "))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in words) * 2 > len(words))


def test_simhash_votes(spark, monkeypatch):
    rng = random.Random(12)
    lines = [" ".join(rng.choices(["a", "bb", "ccc", "dd", "e", "ff", "gg"], k=rng.randint(1, 30))) for _ in range(50)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id bigint, text string")
    words = sorted({w for x in lines for w in x.split(" ")})
    hashed = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    hashes = {r.w: r.h % 2**64 for r in hashed}
    split = line_dedup._lines(df)
    for sims in (line_dedup._simhashes(split), line_dedup._long_simhashes(split)):
        assert {r.doc_id: r.sim % 2**64 for r in sims.collect()} == {i: brute_simhash(x, hashes) for i, x in enumerate(lines)}


def test_line_dedup_by_the_wide_rule(spark):
    """Classes of every rule equal those of a brute-force comparison of all lines."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    lines = []
    for _ in range(8):
        base = [word() for _ in range(rng.choice([8, 12, 20, 40]))]
        for _ in range(20):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.15:
                rng.shuffle(own)  # the same SimHash, far in edits
            lines.append(" ".join(own))
    rows = list(enumerate(lines))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sims = {r.doc_id: r.sim % 2**64 for r in line_dedup._simhashes(line_dedup._lines(df)).collect()}
    _, edit = brute_lines([])
    borders = [64 * i // 7 for i in range(8)]

    def near(i, j):
        x = sims[i] ^ sims[j]
        same = sum((x >> lo) & ((1 << (hi - lo)) - 1) == 0 for lo, hi in zip(borders, borders[1:]))
        return bin(x).count("1") <= 10 and same >= 2 and edit(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j]))

    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if label[i] != label[j] and (lines[i] == lines[j] or near(i, j)):
                label = [label[j] if x == label[i] else x for x in label]
    decided = line_dedup.line_decisions(df, rule=line_dedup.WIDE).collect()
    first = {}
    for i, x in enumerate(label):
        first.setdefault(x, i)
    assert {r.doc_id: (r.kept, r.copies) for r in decided} == {i: (first[x] == i, label.count(x)) for i, x in enumerate(label)}
    assert sum(r.kept for r in decided) < len(lines) / 2


def test_near_lines_are_compared_few_times(spark, monkeypatch):
    """The lines of one group cost about one comparison each, not one for each pair."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(80):
        own = list(base)
        for _ in range(3):
            own[rng.randrange(len(own))] = word()
        rows.append((i, " ".join(own)))
    compared, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    decided = line_dedup.line_decisions(spark.createDataFrame(rows, "doc_id bigint, text string"), rule=line_dedup.WIDE).collect()
    assert max(r.copies for r in decided) > 60 and sum(compared) < 4 * len(rows)


def test_pairs_of_lines_come_from_their_first_common_key(spark):
    """However many keys two lines share, the join makes one row of them, and it sorts by the key alone first."""
    rng = random.Random(17)
    sims = []
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(6):
            own = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                own ^= 1 << b
            sims.append(own)
    rows = [(i, x - 2**64 if x >= 2**63 else x, 100, i, 1) for i, x in enumerate(sims)]
    df = spark.createDataFrame(rows, "id bigint, sim bigint, length int, grp bigint, size bigint")
    rule = line_dedup.WIDE

    def near(key, sim, a_sim, length, a_length):
        return rule.close(sim, a_sim) & rule.first(key, sim, a_sim)

    pairs = line_dedup._small_crossing_pairs(line_dedup._hosted(df, rule), rule, near)
    borders = [64 * i // 7 for i in range(8)]

    def close(x):
        return bin(x).count("1") <= 10 and sum((x >> lo) & ((1 << (hi - lo)) - 1) == 0 for lo, hi in zip(borders, borders[1:])) >= 2

    want = [(i, j) for j in range(len(sims)) for i in range(j) if close(sims[i] ^ sims[j])]
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted(want) and len(want) > 300
    assert "Sort [key#" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_line_keys_are_not_shuffled(spark, monkeypatch):
    """A line is dealt once for each block that begins a choice, not once for each choice."""
    rng = random.Random(16)
    rows = [(i, " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12))) for i in range(40)]
    plans, materialize = {}, common.materialize

    def seen(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, tag)

    monkeypatch.setattr(common, "materialize", seen)
    assert line_dedup.line_decisions(spark.createDataFrame(rows, "doc_id bigint, text string"), rule=line_dedup.WIDE).count() == 40
    assert "hashpartitioning(host" in plans["crossing-pairs"] and "hashpartitioning(key" not in plans["crossing-pairs"]


def test_lines_of_repeated_and_null_ids(spark):
    rows = [
        (9, "shared line here"), (9, "lonely line\nfoo\nshared line here"), (None, "unique first\nshared line here"),
        (None, "unique second\nshared line here"), (3, "a\na\n"), (3, "a\na\n"), (4, None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    decided = line_dedup.line_dedup(df, rule=line_dedup.WIDE)
    got = sorted((r.doc_id or 0, r.n_lines, r.n_kept) for r in decided.collect())
    shared_first = got[-2:] == [(9, 1, 1), (9, 3, 2)]  # which of the two rows comes first is decided by their text hashes
    assert got == [(0, 2, 1), (0, 2, 1), (3, 3, 1), (3, 3, 2), (4, 1, 1), *([(9, 1, 1), (9, 3, 2)] if shared_first else [(9, 1, 0), (9, 3, 3)])]
    left = [r.text for r in line_dedup.without_lines(df, decided).collect()]
    assert len(left) == len(rows) and None in left
    every = "\n".join(x for x in left if x is not None).split("\n")
    assert sorted(x for x in every if x) == ["a", "foo", "lonely line", "shared line here", "unique first", "unique second"]


def test_block_keys_find_all_close_hashes(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        h = rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 3)):
            rows.append((i, h))
            h ^= 1 << b
        rows.append((i, h))
    rows = [(i, h - 2**64 if h >= 2**63 else h) for i, h in rows]
    for blocks in (4, 5, 6):
        keyed = spark.createDataFrame(rows, "i int, h bigint").select("i", "h", line_dedup.block_keys(F.col("h"), blocks).alias("k")).collect()
        by = defaultdict(list)
        for r in keyed:
            by[r.i].append(set(r.k))
        assert all(a & b for group in by.values() for a in group for b in group)


# -- URLs


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme/adult": ("", "", None, "block"),
        "http://A.Example.COM/en/1?x#y": ("a.example.com", "/en/1", "com/en/", "block"),
        "http://example.com/en/7?porn": ("example.com", "/en/7", "example.com/en/7", "allow"),
        "http://xexample.com/en/7": ("xexample.com", "/en/7", "com/en/", "block"),
        "https://a.net/de/": ("a.net", "/de/", "net/de/", "allow"),
        "https://www.example.net/de/81": ("www.example.net", "/de/81", "example.net/de/8", "block"),
        "https://org/es/": ("org", "/es/", "org/es/", "block"),
        "http://x.example.net?q://z/": ("x.example.net", "", None, "allow"),
        "http://pornography.example.net/a": ("pornography.example.net", "/a", None, "allow"),
        "http://free-deal.example.net/a": ("free-deal.example.net", "/a", None, "block"),
        "http://free.example.net/free": ("free.example.net", "/free", None, "allow"),
        "http://spam-farm.example.net/": ("spam-farm.example.net", "/", None, "block"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id bigint, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_urls_with_a_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Bad", 1.0), ("soso", 0.4), ("meh", 0.3), ("meh", None), ("low", 0.1), ("", 9.0), (None, 1.0)], "term string, weight double")
    vocabulary = url_filter.load_vocabulary(terms)
    assert vocabulary == [("bad", 1.0), ("low", 0.1), ("meh", 0.5), ("soso", 0.4)]
    cases = {"http://a/BAD": "block", "http://a/badly": "allow", "http://a/soso-meh": "allow", "http://a/soso/soso/soso": "allow", "http://a/soso-meh-low": "block"}
    df = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df, (), vocabulary).collect()}
    assert got == dict(enumerate(cases.values()))
    assert {r.verdict for r in url_filter.judge_urls(df, (), ()).collect()} == {"allow"}


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_shuffle_files_of_finished_plans_are_gone_before_the_next_step(spark):
    before = shuffle_files(spark)
    plans = [spark.range(10_000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()]
    assert len(plans[0].collect()) == 7
    made = shuffle_files(spark) - before
    plans.append(plans)  # only a collection lets go of it
    del plans
    common.free_shuffles(spark)
    assert made and not made & shuffle_files(spark)
