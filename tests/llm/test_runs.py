"""Runs against a brute-force search over all lags."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from gridmeter.llm.runs import WORD, collapsed, op13_runs, periodic_runs, planted, with_runs


def smallest_period(w):
    fail = [0] * len(w)
    for i in range(1, len(w)):
        k = fail[i - 1]
        while k and w[i] != w[k]:
            k = fail[k - 1]
        fail[i] = k + (w[i] == w[k])
    return len(w) - fail[-1]


def brute(w):
    """Every stretch of agreement at every lag; kept if the lag is its smallest period."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q) and smallest_period(w[i : j + q]) == q:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    return [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_two_words(w):
    assert periodic_runs(w) == brute(w)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 8)), max_size=8))
def test_powers_of_blocks(blocks):
    w = [c for b, n in blocks for c in b * n]
    assert periodic_runs(w) == brute(w)
    assert collapsed(w, brute(w)) == brute_collapsed(w, brute(w))


@pytest.mark.parametrize("seed", range(6))
def test_long_periods_and_nested_runs(seed):
    r = random.Random(seed)
    inner = [r.choice("xyz") for _ in range(r.randint(1, 40))]
    base = inner * 3 + [str(r.randint(0, 50)) for _ in range(r.randint(1, 60))]
    w = [str(r.random()) for _ in range(9)] + base * r.randint(2, 4) + base[: r.randint(0, 9)] + list("ab" * 30) + base
    assert periodic_runs(w) == brute(w)


def test_fibonacci_words_and_one_word():
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    assert periodic_runs(b) == brute(b)
    assert periodic_runs(["a"] * 20_000) == [(0, 20_000, 1)]
    assert periodic_runs(["a"] * 11) == [] and periodic_runs(["a"] * 12) == [(0, 12, 1)]
    assert periodic_runs(list("abcdef") * 2) == [(0, 12, 6)] and periodic_runs(list("abcdefg") * 2 + ["a"]) == [(0, 15, 7)]


def test_far_copies_of_a_passage_are_no_run():
    passage = [str(i) for i in range(500)]
    assert periodic_runs(passage + ["x"] + passage) == []
    assert periodic_runs(passage + ["x"] + passage + ["x"]) == [(0, 1002, 501)]
    assert periodic_runs(passage + ["x", "y"] * 3 + list(map(str, range(600, 1200))) + passage) == []


def altered(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def expected(doc_id, text):
    w = altered(doc_id, WORD.findall(text or ""))
    runs = brute(w) if len(w) < 1500 else periodic_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = (sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(brute_collapsed(w, runs))))
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in op13_runs(spark, SF).collect()}
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got.values()) > 50
    for doc_id, text in rows:
        assert got[doc_id] == expected(doc_id, text), doc_id


def test_odd_rows(spark, tmp_path):
    texts = [None, "", " \t\n", "one", "a " * 40, "a b " * 8 + "  c", "x" * 100_000, "n\x1fo " * 13]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a " * 20), (7, "a " * 20), (7, "a " * 20)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_runs", F.lit(9)).withColumn("_w", F.lit(1)).write.parquet(path)
    got = sorted((tuple(r) for r in op13_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected(*r) for r in rows), key=repr)


def test_empty_table_and_planted_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert planted(none).select(with_runs(F.col("text"))).count() == 0
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15") for i in ids]
    for r in planted(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.text.split(" ") == altered(r.doc_id, [f"w{k}" for k in range(16)])
