"""The pipeline stage by stage against brute force, and the registered queries against SQL."""

import os
import random
import re

import duckdb
import pytest

import corpus_pipeline
from tracklake.llm import entry
from tracklake.llm.common import table

from .test_learned_ops import brute_classes, near_texts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    texts = near_texts(rng, 120, 3) + [None, "", "  ", "long " * 5000]
    texts += [t.replace(" ", "  ", 3) for t in texts[:10] if t]
    rows, labels = [], []
    for i, t in enumerate(texts):
        toxic = i % 6 == 0 and bool(t) and len(t) > 30
        rows.append((i, t if not toxic else t + f" you grumpkin{i} grumpkin", "en", "s", len(t or "")))
        labels.append((i, 1, int(toxic)))
    place = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return str(place), rows, labels


def test_stages(spark, corpus, tmp_path):
    place, rows, labels = corpus
    docs, texts, toxic = table(spark, place, "documents"), {r[0]: r[1] for r in rows}, {i for i, _, y in labels if y}
    columns = docs.dtypes
    left = sorted(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, place)
        assert kept.dtypes == columns
        kept.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        found = sorted(r.doc_id for r in docs.collect())
        if name == "toxicity":
            want = [i for i in left if i not in toxic]
        elif name == "exact_dedup":
            key = lambda i: re.sub("[\x20\x09-\x0d]+", " ", texts[i] or "")
            first = {}
            for i in left:
                first.setdefault(key(i), i)
            want = sorted(first.values())
        else:
            classes = brute_classes([(i, texts[i]) for i in left])
            want = [i for i in left if classes[i][0] == i]
        assert found == want, name
        left = found
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, place).collect()
    assert sorted({r.doc_id for r in packed}) == left
    again = corpus_pipeline.run(spark, place).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, packed))


def test_stages_on_null_and_repeated_ids(spark, corpus):
    """Rows are dropped, not ids: different texts under one id stay, and one of equal rows does."""
    place, _, _ = corpus
    rng = random.Random(16)
    text = lambda: " ".join("".join(rng.choices("mnpqrst", k=5)) for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(3, a), (5, a), (5, b), (None, a), (None, c), (5, d), (None, d + " end"), (6, e), (6, e), (None, None), (None, None), (7, b.replace(" ", "  "))]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    exact = corpus_pipeline.drop_copies(spark, docs, place)
    assert exact.dtypes == docs.dtypes
    left = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    want = [("3", a), ("5", b), ("None", c), ("5", d), ("None", d + " end"), ("6", e), ("None", "None")]
    assert left(exact) == sorted(want)
    near = corpus_pipeline.drop_near_copies(spark, docs, place)
    assert left(near) == sorted([x for x in want if not x[1].endswith(" end")])
    assert corpus_pipeline.drop_toxic(spark, docs, place).count() == len(rows)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), place).count() == 0
    assert corpus_pipeline.drop_copies(spark, docs.limit(0), place).count() == 0


def plain(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in cursor.fetchall()), key=repr)
    assert got == want


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
