"""Queries and pipeline on a small corpus written as the driver's tables are."""

import random

import pytest

import corpus_pipeline
from strata3d.llm.queries import ORACLE, QUERIES

from .test_dedup import say


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, at = random.Random(12), tmp_path_factory.mktemp("corpus")
    item = say(rng, 40)
    rows = [(i, say(rng, 60) + "\nAll rights reserved by us", "en" if i % 2 else "de", f"s{i % 3}") for i in range(40)]
    rows += [(50, rows[3][1], "en", "s0"), (51, "12 !!", None, None), (52, None, None, "s1"), (53, "", "en", "s1"),
             (54, say(rng, 10) + " " + item + " " + say(rng, 10), "en", "s2"), (55, "All rights reserved by us", "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "http://a/1", "<article><p>Text of it</p></article>"), (2, None, None)],
                          "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(c, t, "user", f"turn {t} of {c % 3}") for c in range(9) for t in range(3)],
                          "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(30)],
                          "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return str(at), docs


def test_every_query_answers(spark, corpus):
    for name, query in QUERIES.items():
        rows = query(spark, corpus[0]).collect()
        if "doc_id" in rows[0].asDict() and "item_id" not in rows[0].asDict():
            assert len(rows) == corpus[1].count(), name
    assert set(ORACLE) <= set(QUERIES)


def test_stages_take_effect(spark, corpus):
    path, docs = corpus
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "encoding":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            docs = spark.createDataFrame(out.collect(), out.schema)
            seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
        else:
            assert out.count() == docs.count()
    language, lines, near, clean = seen
    assert not {51, 52, 53} & set(language) and set(range(40)) <= set(language)
    assert sum("All rights" in t for t in lines.values()) == 1
    assert len({3, 50} & set(near)) == 1
    assert 54 in near and 54 not in clean
    assert set(range(40)) - {3} <= set(clean)
    assert len({r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()} ^ set(clean)) == 0


def test_empty_corpus(spark, corpus, tmp_path):
    path, docs = corpus
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0
