"""Toxicity and quality: held-out accuracy, located sentences, odd inputs."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from gridmeter.llm import common as C
from gridmeter.llm import labels as L
from gridmeter.llm import quality as Q
from gridmeter.llm import toxicity as T


@pytest.fixture(scope="module")
def labelled():
    return duckdb.sql(f"SELECT l.doc_id, d.text, l.toxic, l.quality FROM '{SF}/labels.parquet' l JOIN '{SF}/documents.parquet' d USING (doc_id)").fetchall()


def split(rows, divisor, held):
    out = lambda r: zlib.crc32(str(r[0]).encode()) % divisor == held
    return [r for r in rows if not out(r)], [r for r in rows if out(r)]


def test_toxicity_on_held_out_documents(labelled):
    train, held = split(labelled, 5, 0)
    model = T.fit([r[1] for r in train], [r[2] for r in train], {0: 1.0, 1: 1.0})
    words = model.words()
    said = [T.document_score(r[1], words, model.bias)[0] >= 0.5 for r in held]
    assert np.mean([a == bool(r[2]) for a, r in zip(said, held)]) >= 0.9


def test_sentences_are_located():
    clean = [f"Nice day number {i}. We walk {i} miles.\nAll is well {i % 9}!" for i in range(200)]
    toxic = [f"Nice day number {i}. You zorgish{['er', 'en', ''][i % 3]} person {i % 7}! We walk on {i}." for i in range(60)]
    model = T.fit(clean + toxic, [0] * 200 + [1] * 60, {0: 1.0, 1: 1.0})
    text = "A day. Oh you zorgishly thing! Good night."
    score, spans = T.document_score(text, model.words(), model.bias)
    assert score > 0.9 and [text[a:b].strip() for a, b, _ in spans] == ["Oh you zorgishly thing!"]
    assert T.document_score(clean[0] * 50, model.words(), model.bias)[0] < 0.5  # many clean sentences stay clean


def test_length_does_not_make_a_text_toxic(spark):
    model = T.SentenceModel(-7.0, {"zorg": 12.0, "dull": 2.0})
    clean = "A fine day it is. What a dull day! " * 50_000  # half of them with a weak feature
    toxic = clean + "You zorg."
    assert T.document_score(clean, model.words(), model.bias)[0] < 0.5 and T.document_score("Fine. " * 100_000, model.words(), model.bias) == (0.0, [])
    score, spans = T.document_score(toxic, model.words(), model.bias)
    assert score > 0.9 and [toxic[a:b].strip() for a, b, _ in spans] == ["You zorg."]
    df = spark.createDataFrame([(1, clean), (2, toxic)], "doc_id long, text string")
    assert [r.doc_id for r in T.reject_toxic(df, model).collect()] == [1]


def test_scores_of_odd_texts_and_kept_rows(spark):
    model = T.SentenceModel(-6.0, {"zorg": 12.0})
    rows = [(1, "zorg you", "x"), (2, None, "x"), (None, "", "x"), (3, "fine " * 30_000, "x"), (4, "ZORG!!", "x"), (2, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = df.select("doc_id", T.scorer(model)("text").alias("s")).select("doc_id", "s.score").collect()
    assert all(0.0 <= r.score <= 1.0 for r in out) and {r.doc_id for r in out if r.score >= 0.5} == {1, 4}
    kept = T.reject_toxic(df, model)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "3", "None"]
    assert T.reject_toxic(df.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1, None), (2, None, 1)], "doc_id long, toxic int, quality int").limit(0)
    model = T.train(docs, none, learn=F.lit(True))
    assert all(r.s < 0.5 for r in docs.select(T.scorer(model)("text")["score"].alias("s")).collect())
    assert Q.train(docs, none, learn=F.lit(True)) is None
    assert [r.s for r in docs.select(Q.scorer(spark, None)(F.col("text")).alias("s")).collect()] == [0.5, 0.5]


def test_sample_leaves_out_held_out_and_null_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(None, "x"), (60, "y" * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (51, None), (60, 1), (3, 0)], "doc_id long, toxic int")
    sample, sizes = L.labelled_sample(docs, labels, "toxic", learn=L.id_remainder(labels["doc_id"], 5) != 0, most_per_class=100, most_chars=50)
    want = sorted((f"text {i}", i % 2) for i in range(50) if zlib.crc32(str(i).encode()) % 5)
    assert sorted(sample) == want and sum(sizes.values()) == len(want) + (zlib.crc32(b"60") % 5 != 0)


def test_quality_on_held_out_documents(labelled):
    train, held = split(labelled, 3, 1)
    model = Q.fit([r[1] for r in train], [r[3] for r in train], {0: 1.0, 1: 1.0})
    scores = Q.vote(model, Q.Embedder(model.terms, model.directions), [r[1] for r in held])
    assert np.mean([(s >= 0.5) == bool(r[3]) for s, r in zip(scores, held)]) >= 0.95


def test_long_words_count_whole():
    assert Q.shape("a" * 100 + "1" * 100 + "B") == "a0A"
    blob = "a-" * 60 + "0+" * 60
    assert Q.word_terms(blob)[:-1] == ("s:" + "a-" * 32, "s:" + "a-" * 28 + "0+" * 4, "s:" + "0+" * 32, "s:" + "0+" * 24)
    terms = {t: i for i, t in enumerate([*Q.word_terms("a-" * 32), *Q.word_terms("0+" * 32)])}
    emb = Q.Embedder(terms, np.eye(len(terms), dtype=np.float32))
    long = emb.term_counts(blob)
    assert long == {terms["s:" + "a-" * 32]: 1, terms["s:" + "0+" * 32]: 1}
    # a word equal to the beginning of a longer one that came before has its own terms
    assert emb.term_counts("a-" * 32) == {terms["s:" + "a-" * 32]: 1, terms["w:" + "a-" * 32]: 1}


def test_votes_are_exact_nearest_neighbours(spark, labelled):
    train, held = split(labelled, 3, 1)
    model = Q.fit([r[1] for r in train], [r[3] for r in train], {0: 2.0, 1: 1.0}, neighbours=5)
    emb = Q.Embedder(model.terms, model.directions)
    texts = [r[1] for r in held[:40]] + ["", " ", "zzzz qqqq"]
    got = Q.vote(model, emb, texts)
    for t, s in zip(texts, got):
        v = emb.vectors([t])[0]
        if not v.any():
            assert s == pytest.approx(model.prior, abs=1e-6)
            continue
        near = sorted(range(len(train)), key=lambda i: -float(v @ model.vectors[i]))[:5]
        w = [max(0.0, float(v @ model.vectors[i])) ** 8 * model.weights[i] for i in near]
        assert s == pytest.approx(sum(a * model.labels[i] for a, i in zip(w, near)) / sum(w), abs=1e-3)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, score string")
    out = {r.doc_id: r.s for r in df.select("doc_id", Q.scorer(spark, model)(F.col("score")).alias("s")).collect()}
    assert [out[i] for i in range(len(texts))] == pytest.approx(list(got), abs=1e-5) and out[len(texts)] == pytest.approx(model.prior, abs=1e-6)


def test_queries_have_the_contract_columns(spark):
    from gridmeter.llm.catalog import QUERIES

    for name in ("op4_toxicity", "op8_quality"):
        out = QUERIES[name](spark, SF)
        assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert C.table(spark, SF, "documents").count() == 1000
