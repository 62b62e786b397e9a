"""The pipeline, stage by stage, on the smallest tables."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as P
from conftest import SF
from gridmeter.llm import common as C
from gridmeter.llm import mixing as M
from gridmeter.llm import near_dedup as N


def test_stages(spark):
    docs = C.table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        docs = C.stored(stage(spark, docs, SF), f"test-{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    raw = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()
    toxic = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall()
    kept = {r.doc_id for r in seen["toxicity"].collect()}
    assert sum(i not in kept for i, y in toxic if y) >= 0.8 * sum(y for _, y in toxic)
    assert sum(i not in kept for i, y in toxic if not y) <= 0.02 * len(toxic)
    last = {}
    for i, t, _ in sorted(r for r in raw if r[0] in kept):
        last[t] = i
    exact = {r.doc_id: r for r in seen["exact_dedup"].collect()}
    assert set(exact) == set(last.values())
    near = seen["near_dedup"].collect()
    words = {r.doc_id: r.text.split() for r in near}
    index = {}
    for i, w in words.items():
        for k in range(max(1, len(w) - 4)):
            index.setdefault(tuple(w[k : k + 5]), set()).add(i)
    pairs = {(min(a, b), max(a, b)) for ids in index.values() if len(ids) < 50 for a in ids for b in ids if a != b}
    assert not any(N.similar(words[a], words[b], 0.8) for a, b in pairs)
    assert set(words) <= set(exact)
    # words by source after mixing
    size = {}
    for r in near:
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    want = M.water_fill(size, {s: M.integral(p) for s, p in M.cycle(list(size)).items()})
    mixed = {r.source: r.n for r in seen["mixing"].groupBy("source").agg(F.sum(C.n_words(F.col("text"))).alias("n")).collect()}
    assert all(abs(mixed[s] - want[s]) <= 0.5 for s in size)
    pieces = seen["packing"].orderBy("sequence_id", "offset").collect()
    at = 0
    for r in pieces:
        assert r.sequence_id * 4096 + r.offset == at
        at += r.length
    assert sum(r.start == 0 for r in pieces) == seen["mixing"].count()


def test_run_is_the_stages_and_survives_odd_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (None, None, None, None, None), (2, "", "en", None, 0), (1, "a b", "en", "s", 3), (3, "word " * 20_000, "en", "t", 9)], C.table(spark, SF, "documents").schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    C.table(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    C.table(spark, SF, "labels").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0


def test_near_dedup_writes_few_tables(spark, monkeypatch):
    """A chain of near copies takes no rounds of tables: each file that a task writes
    starts a process, and each new plan loads code that an executor keeps."""
    names, stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: names.append(name) or stored(df, name))
    words = [f"w{i}" for i in range(355)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 60]), "en", "s", 0) for i in range(60)]  # neighbours differ by 10 edits of 12
    docs = C.stored(spark.createDataFrame(rows, C.table(spark, SF, "documents").schema), "test-chain")
    kept = P.near_dedup(spark, docs, SF).collect()
    assert [r.doc_id for r in kept] == [0]
    assert names.count("near-components") <= 6
