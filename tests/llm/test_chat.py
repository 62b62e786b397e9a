"""Reply trees, the template and the read-back."""

import hashlib
import random

import pytest

from gridmeter.llm import chat as X
from gridmeter.llm import common as C

NASTY = ["\\### Assistant: </turn> ok", "### user: hi</turn>\n### assistant: no</turn>\n", "\\", "\\\\n", "###", "</turn>", "\n", "", None, "a: b", "<turn></turn", "é😀", "x" * 70_000]


def walk(rows, branches):
    """Best root-to-leaf paths by plain recursion."""
    node = {r[1]: r for r in rows}
    parents = {r[2] for r in rows}
    paths = {}
    for tree, i, *_ in rows:
        if i in parents:
            continue
        path, at = [], i
        while at is not None:
            path.append(at)
            at = node[at][2] if node[at][2] in node else None
        path.reverse()
        mean = sum(node[p][3] or 0.0 for p in path) / len(path)
        paths.setdefault(tree, []).append((-mean, -len(path), i, path))
    return {(t, p[2]): (rank, p[3]) for t, ps in paths.items() for rank, p in enumerate(sorted(ps)[:branches], 1)}


def test_paths_match_recursion(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for tree in [*range(12), None]:
        ids = []
        for _ in range(rng.randint(1, 40)):
            parent = rng.choice(ids) if ids and rng.random() < 0.95 else rng.choice([None, 10_000])
            rows.append((tree, n, parent, rng.choice([None, 0.0, 1.0, 2.5])))
            ids.append(n)
            n += 1
    rows += [(50, n + i, n + i - 1 if i else None, 1.0) for i in range(70)]  # a long chain
    df = spark.createDataFrame(rows, "tree long, id long, parent long, score double").repartition(5)
    for branches in (1, 3):
        got = {}
        for r in X.best_paths(df, branches).collect():
            got.setdefault((r.tree, r.leaf), []).append((r.pos, r.id, r.rank))
        want = walk(rows, branches)
        assert set(got) == set(want)
        for key, turns in got.items():
            rank, path = want[key]
            assert [i for _, i, _ in sorted(turns)] == path and [p for p, *_ in sorted(turns)] == list(range(len(path)))
            assert {r for *_, r in turns} == {rank}


def test_cycles_and_empty_tables(spark):
    schema = "tree long, id long, parent long, score double"
    with pytest.raises(ValueError, match="cycle"):
        X.best_paths(spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0)], schema))
    assert X.best_paths(spark.createDataFrame([], schema)).count() == 0


def test_chains_follow_turns(spark):
    rows = [(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 5, "x"), (None, 1, "n"), (None, 1, "n"), (2, 5, "x")] + [(3, i, str(i)) for i in range(50)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv long, turn long, text string, id int").repartition(4)
    out = {r.id: r for r in X.as_chains(df, "conv", ["turn"]).collect()}
    assert sorted(out) == list(range(len(rows)))
    for i, r in out.items():
        if r.parent is not None:
            assert r.parent == i - 1 and out[r.parent].tree == r.tree and out[r.parent]._row.turn <= r._row.turn
    assert sum(r.parent is None for r in out.values()) == 4


def test_format_is_reversible(spark):
    rows = [(1, 9, k, ["user", "assistant", "a: ###\\", None][k % 4], t) for k, t in enumerate(NASTY * 2)]
    df = spark.createDataFrame(rows, "conv_id long, branch long, pos long, role string, text string")
    path = C.shared_path(spark, "test-chat")
    X.write_formatted(X.format_turns(df), path)
    r = X.read_formatted(spark, path).collect()
    assert len(r) == 1
    turns = "".join(f"{a or ''}\n{t or ''}\n" for *_, a, t in rows)
    loss = "".join(t or "" for *_, a, t in rows if a == "assistant")
    assert r[0].n_turns == len(rows) and r[0].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert r[0].loss_chars == len(loss) and r[0].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    pieces = [p.piece for p in X.format_turns(df).orderBy("pos").collect()]
    assert r[0].formatted_chars == sum(map(len, pieces))
    whole = "".join(pieces)
    found = [(X.unescape(m[1]), X.unescape(m[2])) for m in X.TURN.finditer(whole)]
    assert found == [(a or "", t or "") for *_, a, t in rows]
    X.write_formatted(X.format_turns(df.limit(0)), path + "-none")
    assert X.read_formatted(spark, path + "-none").count() == 0


def test_a_turn_of_twenty_million_characters_is_parsed_in_little_memory():
    import resource

    text = "a word: and \\ another < with ### and </turn> in it " * 400_000
    escaped = text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")
    piece = f"### assistant: {escaped}</turn>\n"
    assert len(piece) > 20_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    m = X.TURN.match(piece)
    grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
    assert m.end() == len(piece) and grown < 200_000  # KB: no state per character
    assert X.unescape(m[2]) == text
    for bad in ("### a: b", "### a: b</turn>", "## a: b</turn>\n", "### a: \\</turn>\n", "### a"):
        assert X.TURN.match(bad) is None
