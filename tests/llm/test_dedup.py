"""Exact dedup: the quotient filter, groups and dropped rows."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridmeter.llm import dedup as D


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 255), max_size=60), min_size=1, max_size=4))
def test_filters_merge_without_loss(parts):
    filters = [D.CountingQuotientFilter.of(8, np.array(p, np.uint64)) for p in parts]
    filters = [D.CountingQuotientFilter.from_bytes(f.to_bytes()) for f in filters]
    keys, counts = D.merge(filters).items()
    want = Counter(x for p in parts for x in p)
    assert dict(zip(keys.tolist(), counts.tolist())) == want
    assert keys.tolist() == sorted(want)
    assert all(filters[0].count(x) == Counter(parts[0])[x] for x in range(0, 256, 17))


def test_counts_stay_whole_numbers():
    """Beyond 2^53, where floats skip whole numbers."""
    big = (1 << 53) + 1
    one = D.CountingQuotientFilter.of(16, np.array([5, 9, 5], np.uint64), np.array([big, 1, 2], np.uint64))
    two = D.CountingQuotientFilter.from_bytes(one.to_bytes())
    keys, counts = D.merge([one, two, D.CountingQuotientFilter.of(16, np.zeros(0, np.uint64))]).items()
    assert keys.tolist() == [5, 9] and counts.tolist() == [2 * (big + 2), 2]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return {(i, t): (keep[t or ""], len(groups[t or ""])) for i, t in rows}


def test_groups_match_brute_force(spark):
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(50, None), (51, ""), (None, ""), (60, "only"), (None, "null id"), (None, "null id")]
    rows += [(39, "text 4"), (70, "é" * 50_000), (71, "é" * 50_000), (72, "é" * 49_999 + "e")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, keep_id string, _fp int").repartition(5)
    want = brute(rows)
    for broadcast in (500_000, 0):
        out = D.exact_groups(df, broadcast_rows=broadcast).collect()
        assert len(out) == len(rows)
        import hashlib

        texts = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in rows}
        kept = Counter()
        for r in out:
            t = texts[r.text_sha256]
            key = (r.doc_id, t) if (r.doc_id, t) in want else (r.doc_id, None)
            assert (r.keep_id, r.group_size) == want[key]
            kept[t] += r.kept
        assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows})


def test_drop_keeps_one_row_of_each_text(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, "c"), (None, "c"), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, _sum string")
    for broadcast in (500_000, 0):
        out = D.drop_exact(df, broadcast_rows=broadcast)
        assert out.columns == df.columns
        assert sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str) == sorted([(2, "a"), (3, "b"), (None, "c"), (5, "")], key=str)
    assert D.drop_exact(df.limit(0)).count() == 0 and D.exact_groups(df.limit(0)).count() == 0
