"""Token ids, token files and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmeter.llm import common as C
from gridmeter.llm import packing as P
from gridmeter.llm import token_files as TF
from gridmeter.llm import tokens as T

TEXTS = ["The cat, the Cat.", None, "", " \n\t ", "a\x1cb c\x1f d", "x\x01y \x01", "<|endoftext|> hi <|startoftext|>,", "İstanbul ΣΑΣ. Σ",
         "éa café Å.", "don't we'll 'S 's. it's,", "a b c　d\x85e", "日本語、です。 한국어", "≠ x≠",
         "ﬁ ǅ", "x" * 300 + " " + "ab," * 50, "́a", "1,234.5 3rd №5 Ⅷ.", "word " * 3000]


@pytest.fixture(scope="module")
def pieces():
    return T.PieceIds(T.default_tokenizer())


def plain(pieces, text):
    return np.array(pieces._encode(text or ""), "<u4").tobytes()


def test_pieces_give_the_tokenizers_ids(pieces):
    for t in TEXTS:
        assert pieces.texts([t])[0] == plain(pieces, t), repr((t or "")[:40])
    rng = random.Random(3)
    letters = list("aB1.,'ß ) (éİΣ<|>\x01\x1c\x1d \n\tſ日😀_-≠̀")
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert pieces.texts([t])[0] == plain(pieces, t), repr(t)


def frame(spark, extra=()):
    rows = [(i * 3 % 19 if i != 7 else None, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, "The cat, the Cat.", "x", "y")] * 2 + list(extra)
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start string")


def test_token_files_round_trip_and_single_documents(spark, pieces):
    df = frame(spark)
    path = C.shared_path(spark, "test-token-files")
    TF.write_token_files(df, path, segment_bytes=200)
    out = TF.read_token_files(spark, path).orderBy("start").collect()
    assert len(out) == df.count()
    at = 0
    for r in out:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    ids = [r.doc_id for r in out]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    want = sorted((str(r.doc_id), plain(pieces, r.text) + b"\x02\0\0\0") for r in df.collect())
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in out) == want
    one = TF.read_token_files(spark, path, [3]).collect()
    assert {(r.doc_id, r.start, bytes(r.ids)) for r in one} == {(r.doc_id, r.start, bytes(r.ids)) for r in out if r.doc_id == 3}


def test_token_files_dictionary_is_shared(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda x: F.concat(F.lit("w"), ((x * (F.col("id") + 7)) % 50).cast("string")))).alias("text"))
    path = C.shared_path(spark, "test-token-files")
    TF.write_token_files(df, path, dictionary_bytes=4096)
    d = spark.read.parquet(f"{path}/dictionary").first()
    assert len(d["dictionary"]) > 0
    assert {r["dictionary"] for r in spark.read.parquet(f"{path}/segments").select("dictionary").collect()} == {d["hash"]}
    assert TF.read_token_files(spark, path).count() == 600


def test_token_files_of_an_empty_table(spark):
    path = C.shared_path(spark, "test-token-files")
    TF.write_token_files(frame(spark).limit(0), path)
    assert TF.read_token_files(spark, path).count() == 0


def test_packing_cuts_every_id_into_one_piece(spark, pieces):
    df = frame(spark).repartition(3)
    out = P.concat_and_cut(df, length=64).collect()
    total = 0
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 64 + r.offset == total and r.length * 4 == len(r.ids) and r.offset + r.length <= 64
        total += r.length
    want = [plain(pieces, r.text) + b"\x02\0\0\0" for r in df.collect()]
    assert total == sum(map(len, want)) // 4
    joined = b"".join(bytes(r.ids) for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)))
    found = []
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            found.append(b"")
        found[-1] += bytes(r.ids)
    assert sorted(found) == sorted(want)
    seq = P.sequences(spark.createDataFrame(out), 64).orderBy("sequence_id").collect()
    assert all(len(s.ids) == 256 for s in seq) and b"".join(bytes(s.ids) for s in seq)[: 4 * total] == joined
    digests = P.piece_digests(spark.createDataFrame(out)).collect()
    assert sorted(d.ids_crc32 for d in digests) == sorted(zlib.crc32(bytes(r.ids)) for r in out)


def test_packing_keeps_the_order_of_files(spark):
    path = C.shared_path(spark, "test-pack")
    spark.range(500).select((F.lit(1000) - F.col("id")).alias("doc_id"), F.lit("some words here").alias("text")).repartitionByRange(7, F.desc("doc_id")).write.parquet(path)
    out = P.concat_and_cut(spark.read.parquet(path), length=50).orderBy("sequence_id", "offset").collect()
    ids = [r.doc_id for r in out if r.start == 0]
    blocks = [i // 72 for i in (1000 - x for x in ids)]
    assert len(ids) == 500 and blocks == sorted(blocks)


def test_packing_an_empty_table(spark):
    assert P.concat_and_cut(frame(spark).limit(0)).count() == 0


def test_units_stand_in_the_order_of_part_numbers(spark):
    """Beyond 100,000 parts the names' text order breaks."""
    df = spark.createDataFrame([(f"file:/a/part-{n}.parquet", b, 0) for n in ("99999-x", "100000-x", "00007-x") for b in (64, 0)] + [("file:/a/b/part-00001.parquet", 0, 0), ("", 0, 3)], "_file string, _block long, _part int")
    got = [(r._file, r._block) for r in df.orderBy(*[F.expr(x) for x in P.ORDER]).collect()]
    part = lambda n: [(f"file:/a/part-{n}-x.parquet", 0), (f"file:/a/part-{n}-x.parquet", 64)]
    assert got == [("", 0), *part("00007"), *part("99999"), *part("100000"), ("file:/a/b/part-00001.parquet", 0)]


def test_only_a_proven_tokenizer_is_cut(spark):
    import public_tokenizers

    assert T.cuts_into_words(T.default_tokenizer()) and not T.cuts_into_words(public_tokenizers.path("byte_bpe_50k.json"))
    other = T.PieceIds(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ["Hello World, this is a Test of Case", *TEXTS]:
        assert other.texts([t])[0] == plain(other, t)


def test_latin_texts_and_long_texts(pieces):
    rng = random.Random(5)
    letters = [chr(i) for i in range(256)]
    for _ in range(3000):
        t = "".join(rng.choice(letters if rng.random() < 0.5 else "it's don'T WE'LL a1, .\t") for _ in range(rng.randint(0, 30)))
        assert pieces.texts([t])[0] == plain(pieces, t), repr(t)
    block, T.BLOCK_CHARS = T.BLOCK_CHARS, 50
    try:
        for t in ("it's a Day, " * 400, "x" * 1000, " " * 500 + "a", "日本 語、" * 100):
            assert "".join(T.cut_at_blanks(t, 50)) == t and pieces.texts([t, t[:20]]) == [plain(pieces, t), plain(pieces, t[:20])]
    finally:
        T.BLOCK_CHARS = block


def test_two_generations_keep_what_is_used(pieces):
    held, T.PIECES_KEPT = T.PIECES_KEPT, 40
    p = T.PieceIds(T.default_tokenizer())
    try:
        for i in range(200):
            t = f"often used word{chr(97 + i % 26)}{chr(97 + i // 26)} here"
            assert p.texts([t])[0] == plain(pieces, t)
            assert len(p) + len(p.older) <= 60
        assert "often" in p or "often" in p.older
    finally:
        T.PIECES_KEPT = held
