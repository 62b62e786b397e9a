"""One-permutation MinHash against an implementation in plain Python."""

import hashlib
import struct

import xxhash

from gridmeter.llm import fingerprints as P


def h64(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed=seed)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def lanes(text: str) -> list[int]:
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text.strip("\t\n\x0b\x0c\r "))]
    hashes = [h64(w.encode()) for w in words]
    bins: dict[int, int] = {}
    for i in range(max(1, len(words) - 4)):
        h = 42
        for x in hashes[i : i + 5]:  # an array is hashed element by element, each seeding the next
            h = h64(struct.pack("<Q", x), h)
        h = signed(h) | 1
        b = (h + (1 << 63)) >> 57
        bins[b] = min(bins.get(b, h), h)
    full = []
    for i in range(P.BINS):
        a = 0
        if i not in bins:
            while (j := (P.FIRST[i] + a * P.STEP[i]) % P.BINS) not in bins:
                a += 1
            full.append(bins[j])
        else:
            full.append(bins[i])
    low = [(x >> 1) & 255 for x in full]
    return [signed(sum(low[8 * n + t] << (8 * t) for t in range(8))) for n in range(P.LANES)]


def likeness(a, b):
    split = lambda v: [(x >> (8 * t)) & 255 for x in v for t in range(8)]
    share = sum(x == y for x, y in zip(split(a), split(b))) / P.BINS
    return max(0.0, (share - 1 / 256) / (1 - 1 / 256))


TEXTS = ["", None, " \t\n", "one", "one two three four", "one two three four five", "Ünï cödé 日本 text 😀 here and there", "a b c d e f g " * 40,
         " ".join(f"w{i * i % 997}" for i in range(900)), " ".join(f"w{i * i % 997}" for i in range(880)), "x" * 60_000, "lead  and\ttrail \n"]


def test_every_column_matches(spark):
    rows = [(i * 7 % 12, t, "c", 1) for i, t in enumerate(TEXTS)] + [(None, "null id words", "c", 1), (3, TEXTS[9], "c", 1), (3, TEXTS[9], "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lanes string, n_chars int").repartition(4)
    out = P.neighbour_fingerprints(df)
    out = out.select("*", P.resemblance(out["lanes"], out["edited_lanes"]).alias("near"), P.resemblance(out["lanes"], out["next_lanes"]).alias("next"), P.text_form(out["lanes"]).alias("hex"))
    got = out.collect()
    assert len(got) == len(rows)
    keys = sorted({(i is not None, i or 0, signed(h64((t or "").encode())), t or "") for i, t, *_ in rows})
    want = {}
    for k, (some, i, _, t) in enumerate(keys):
        after = keys[(k + 1) % len(keys)][3]
        edit = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        want[(i if some else None, t)] = (edit, after)
    seen = set()
    for r in got:
        (text, (edit, after)) = next((t, w) for (i, t), w in want.items() if i == r.doc_id and lanes(t) == r.lanes and len(t) == r.n_chars)
        seen.add((r.doc_id, text))
        assert r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert r.edited_lanes == lanes(edit) and r.next_lanes == lanes(after)
        assert abs(r.near - likeness(lanes(text), lanes(edit))) < 1e-9 and abs(r.next - likeness(lanes(text), lanes(after))) < 1e-9
        assert r.hex == "".join(f"{x & (1 << 64) - 1:016x}" for x in r.lanes)
    assert seen == set(want)


def test_estimates_follow_the_resemblance(spark):
    base = [f"w{i}" for i in range(1500)]
    rows = [(n, " ".join(base[: 1500 - n] + [f"v{i}" for i in range(n)])) for n in (0, 150, 500, 1000, 1500)]
    out = {r.doc_id: r for r in P.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string"), "text", "f").collect()}
    for n in out:
        true = max(0, 1500 - n - 4) / (1500 + n - 4 + (4 if n else 0)) if n else 1.0
        assert abs(likeness(out[0].f, out[n].f) - true) < 0.13


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    r = P.neighbour_fingerprints(df).first()
    assert r.lanes == r.next_lanes and r.n_chars == 11
    assert P.neighbour_fingerprints(df.limit(0)).count() == 0


def test_columns_of_the_input_keep_their_names(spark):
    names = ["text", "_w", "_s", "_b", "_f", "_x0", "_X1"]
    df = spark.createDataFrame([("a b c d e f g", 1, 2, 3, 4, 5, 6), ("", 7, 8, 9, 10, 11, 12)], names)
    out = P.fingerprinted(df, "text", "lanes")
    assert out.columns == [*names, "lanes"]
    assert sorted(tuple(r)[1:7] for r in out.collect()) == [(1, 2, 3, 4, 5, 6), (7, 8, 9, 10, 11, 12)]


def test_long_texts(spark):
    """Fifty thousand words, and one word of a million characters."""
    texts = [" ".join(f"w{i * i % 9973}" for i in range(50_000)), "x" * 1_000_000]
    rows = P.fingerprinted(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "l").collect()
    assert {r.text: list(r.l) for r in rows} == {t: lanes(t) for t in texts}
