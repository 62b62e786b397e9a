"""Token counts: equal to the libraries' own, and each distinct text encoded once."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from gridmeter.llm import common as C
from gridmeter.llm.token_counts import PieceCounts, default_tokenizer, op11_token_counts, splits_at_blanks, token_counts, tokenizer_version


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def test_query_against_the_tokenizer(spark, whole):
    rows = {r.doc_id: r for r in op11_token_counts(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        n = whole(text or "")
        assert tuple(rows[doc_id]) == (doc_id, len((text or "").encode()), n, n > 1024)


COUNTS = PieceCounts(default_tokenizer())


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "Ab", "the", "'s", "'", "1", "23", ".", "!", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", " ", "᠎", "﻿", "é", "ß", "中", "😀", "<|endoftext|>", "<|", "|>", "\x00"]) | st.text(max_size=3), max_size=14).map("".join))
def test_pieces_give_the_counts_of_whole_texts(whole, text):
    assert COUNTS.text(text) == whole(text)


def test_blanks_before_an_added_token(whole):
    for text in ("\n\n<|endoftext|>", "  <|endoftext|>  a", "<|endoftext|>" * 3, " <|endoftext|>\n\n", "<|endoftext|", "a<|endoftext|>b \n"):
        assert COUNTS.text(text) == whole(text), text


def test_long_texts(whole):
    for text in ("word, other\n" * 90_000, "x" * 200_000, " " * 100_001 + "a" + "\n" * 7):
        assert PieceCounts(default_tokenizer()).text(text) == whole(text)


def test_only_a_proven_tokenizer_is_cut_at_blanks(whole):
    assert splits_at_blanks(default_tokenizer())
    assert not splits_at_blanks(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, tmp_path, name):
    path, texts = public_tokenizers.path(name), ["", "Hello World, this  is a Test", "a\nb", "<|endoftext|> x", "naïve 中文"]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        expected = {x: len(t.encode(x, add_special_tokens=False).ids) for x in texts}
    else:
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_file=path)
        expected = {x: len(t.encode(x)) for x in texts}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r.doc_id]: r.n_tokens for r in token_counts(docs, str(tmp_path), tokenizer=path).collect()}
    assert got == expected


def test_the_cache_is_used_and_grows_by_misses_only(spark, tmp_path):
    cache, version = f"{tmp_path}/cache", tokenizer_version(default_tokenizer())
    rows = lambda: spark.read.parquet(f"{cache}/version={version}")
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (None, None), (2, "a b"), (3, "")], "doc_id long, text string").withColumn("n_tokens", F.lit(-1))
    first = sorted(map(tuple, token_counts(docs, cache).collect()), key=repr)
    assert first == sorted([(1, 3, 2), (2, 3, 2), (None, 0, 0), (2, 3, 2), (3, 0, 0)], key=repr)
    assert rows().count() == 2
    # a count that only the cache can give; and a text that another job has appended too
    planted = rows().withColumn("n_tokens", F.col("n_tokens") + 100)
    again = f"{tmp_path}/again"
    for _ in range(2):
        planted.write.mode("append").parquet(f"{again}/version={version}")
    more = docs.unionByName(spark.createDataFrame([(9, "new text"), (10, "new text")], "doc_id long, text string").withColumn("n_tokens", F.lit(-1)))
    for limit in (0, 1000):
        got = sorted(map(tuple, token_counts(more, again, broadcast_rows=limit).collect()), key=repr)
        assert got == sorted([(1, 3, 102), (2, 3, 102), (None, 0, 100), (2, 3, 102), (3, 0, 100), (9, 8, 2), (10, 8, 2)], key=repr)
    assert spark.read.parquet(f"{again}/version={version}").count() == 5
    # another version has its own counts
    assert tokenizer_version(public_tokenizers.path("word_bpe_49k.json")) != version


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(docs, str(tmp_path)).count() == 0


def test_texts_move_only_if_missing(spark, tmp_path):
    docs = C.table(spark, SF, "documents")
    token_counts(docs, str(tmp_path)).count()
    plan = token_counts(docs, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "_text" not in plan and "MapInArrow" not in plan
