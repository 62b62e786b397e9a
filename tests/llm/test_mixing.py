"""Curriculum mixing: budgets, positions and odd inputs."""

import pytest
from pyspark.sql import functions as F

from gridmeter.llm import common as C
from gridmeter.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, position int"


def docs(spark, rows):
    # columns named like the operator's own must not disturb it
    return spark.createDataFrame([(i, t, s, "x", 7) for i, t, s in rows], SCHEMA)


def takes(df, **kw):
    return M.curriculum_takes(df, C.n_words(df["text"]), tie=F.xxhash64(df["text"]), **kw)


def test_water_fill_caps_and_reshares():
    got = M.water_fill({"a": 1, "b": 10, "c": 89}, {"a": 1, "b": 1, "c": 1})
    assert got == {"a": 3.0, "b": 30.0, "c": 67.0}
    assert M.water_fill({}, {}) == {} and M.water_fill({"a": 0}, {"a": 1}) == {"a": 0.0}


def test_budgets_are_met_to_the_word(spark):
    rows = [(i, " ".join(["w"] * (i % 13)), ["a", "b", None, ""][i % 4]) for i in range(200)] + [(5, "w w", "a")] * 3
    out = takes(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert r.size == len((r.text or "").split())
        used = sum(t.words for t in r.takes)
        assert 0 <= used <= 3 * r.size
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += used
    # code point order, null last: "", a, b, None weigh 1, 2, 3, 1
    total = sum(v[0] for v in by.values())
    want = M.water_fill({s: v[0] for s, v in by.items()}, {"": 1, "a": 2, "b": 3, None: 1})
    assert total == sum(r.size for r in out)
    for s, (_, target, used) in by.items():
        assert target == pytest.approx(want[s]) and abs(used - target) <= 0.5


def test_positions_invert_cumulative_demand(spark):
    rows = [(i, "a b c d", "s") for i in range(50)]
    out = takes(docs(spark, rows), schedules={"s": [(0.0, 1.0), (0.5, 3.0), (1.0, 0.0)]}).collect()
    plan = [(0.0, 1.0), (0.5, 3.0), (1.0, 0.0)]

    def demand(t):  # by small trapezoids
        steps = [t * k / 2000 for k in range(2001)]
        w = [next(a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0]) for a, b in zip(plan, plan[1:]) if x <= b[0] + 1e-12) for x in steps]
        return sum((steps[k + 1] - steps[k]) * (w[k] + w[k + 1]) / 2 for k in range(2000)) / M.integral(plan)

    at = sorted(t.position for r in out for t in r.takes)
    for n, t in enumerate(at):
        assert demand(t) == pytest.approx(4 * n / 200, abs=1e-4)


def test_mix_is_in_order_and_cuts_the_last_use(spark):
    rows = [(1, " one  two\tthree", "a"), (2, "x y z", "b"), (3, None, "b"), (None, "p q", "a")]
    df = docs(spark, rows)
    mixed = M.curriculum_mix(df).collect()
    at = [r.position for r in mixed]
    assert at == sorted(at, key=lambda x: (x is None, x))
    for r in mixed:
        assert len((r.text or "").split()) == r.words
    again = [tuple(r) for r in M.curriculum_mix(df).collect()]
    assert again == [tuple(r) for r in mixed]


def test_empty_table_and_too_many_sources(spark):
    none = docs(spark, [])
    assert takes(none).count() == 0 and M.curriculum_mix(none).count() == 0
    with pytest.raises(ValueError, match="sources"):
        takes(docs(spark, [(1, "a", "x"), (2, "a", "y")]), max_sources=1)
