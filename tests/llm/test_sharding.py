"""Sharding by stratified interleaving."""

from collections import Counter

from pyspark.sql import functions as F

from gridmeter.llm import sharding as S


def frame(spark, n=1000):
    rows = [(i, ["a"] * 5 + ["b", "b", None, ""], i % 3) for i in range(n)]
    return spark.createDataFrame([(i, s[i % 9], f"t{i}", 5) for i, s, _ in rows] + [(None, "a", "n", 5), (7, "b", "t7", 5), (7, "b", "t7", 5)], "doc_id long, source string, text string, shard int").repartition(6)


def test_rows_are_dealt_evenly_and_in_proportion(spark):
    df = frame(spark)
    for broadcast in (100_000, 0):
        out = S.interleaved_shards(df, 8, tie=F.xxhash64("text"), broadcast_sources=broadcast).collect()
        assert len(out) == 1003
        sizes = Counter(r.shard for r in out)
        assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
        for s in range(8):
            assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
        for source, n in Counter(r.source for r in out).items():
            per = [sum(r.source == source for r in out if r.shard == s) for s in range(8)]
            assert max(per) - min(per) <= 2, (source, n, per)
        assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    again = S.interleaved_shards(df, 8, tie=F.xxhash64("text")).collect()
    assert sorted((str(r.doc_id), r.text, r.shard, r.slot) for r in again) == sorted((str(r.doc_id), r.text, r.shard, r.slot) for r in out)


def test_few_rows_and_none(spark):
    df = frame(spark, 0)
    assert sorted(r.shard for r in S.interleaved_shards(df, 8).collect()) == [0, 2, 5]
    assert S.interleaved_shards(df.limit(0), 8).count() == 0


def test_written_shards(spark):
    from gridmeter.llm import common as C

    path = C.shared_path(spark, "test-shards")
    S.write_shards(S.interleaved_shards(frame(spark, 50), 4), path)
    assert sorted(r.n for r in spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n")).collect()) == [13, 13, 13, 14]


def test_sources_of_one_row_are_spread(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "CASE WHEN id < 1000 THEN 'large' ELSE concat('site', id) END AS source", "concat('t', id) AS text")
    out = S.interleaved_shards(df, 4).collect()
    for s in range(4):
        assert 180 <= sum(r.shard == s and r.source != "large" for r in out) <= 320


def test_order_against_plain_python(spark):
    """The same ranks, offsets and cuts, without Spark."""
    import struct

    import xxhash

    def h64(*values):
        seed = 42
        for v in values:
            if v is None:
                continue
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v.n) if isinstance(v, Int) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(data, seed)
        return seed - (1 << 64) if seed >> 63 else seed

    class Int:
        def __init__(self, n):
            self.n = n

    unit = lambda h: (float(h) + float(1 << 63)) / float(1 << 64)
    rows = [(i, f"t{i}", ["a"] * 40 + ["b"] * 7 + [None, "c", ""]) for i in range(900)]
    rows = [(i, t, s[(i * 7) % 50]) for i, t, s in rows] + [(None, "n", "a"), (7, "again", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {(r.doc_id, r.text): (r.shard, r.slot) for r in S.interleaved_shards(df, 8, tie=F.xxhash64("text"), seed=3).collect()}
    placed = []
    for source in {r[2] for r in rows}:
        null, name = int(source is None), source or ""
        own = sorted((r for r in rows if r[2] == source), key=lambda r: (h64(Int(3), r[0]), r[0] is not None, r[0] or 0, h64(r[1])))
        offset = unit(h64(Int(3), Int(null), name))
        placed += [((rank + offset) / len(own), null, name, h64(Int(3), r[0]), r[0] is not None, r[0] or 0, h64(r[1]), r) for rank, r in enumerate(own)]
    placed.sort(key=lambda x: x[:-1])
    n, slots = len(placed), Counter()
    for place, x in enumerate(placed):
        shard = place * 8 // n
        assert got[x[-1][:2]] == (shard, slots[shard]), place
        slots[shard] += 1
