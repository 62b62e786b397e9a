"""Periodic runs of words by seed-and-extend along diagonals.

A run is a maximal stretch of words with smallest period q and a length of at least
max(12, 2 q): words q apart are equal over ``length - q`` places, so the text agrees
with itself, shifted by the lag q, over at least k = max(12 - q, q) places. Lags are
taken in levels: 1 to 11 with k = 6, then k to 2 k - 1 with k = 12, 24, 48 and so on.

At each level all k-grams of a text are indexed by position. Two occurrences of a
gram whose lag belongs to the level are a seed if different words stand before
them: such a pair is the beginning of its diagonal, and every stretch has exactly
one. A seed is extended word by word; a table of the furthest place covered at each
lag stops a second extension there. Of the stretches that a run of smaller
period covers, at a multiple of that period, none is a run of its own; they are
left out before they are extended.

Grams of the next level are pairs of this one's, so only places whose gram recurs
are looked at again. All but the first occurrence of a gram inside a periodic stretch
have the same word before them, which keeps the seeds near linear in the words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import blocks

WORD = re.compile(C.WORD)
LEAST = 12
GRAM = LEAST // 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _grams(ids: np.ndarray) -> np.ndarray:
    """A number for each run of ``GRAM`` words. Unequal runs may share one by
    chance; extension, which compares words, then ends at once."""
    n = len(ids) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for j in range(GRAM):
        out = (out ^ ids[j : j + n].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _repeated(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at`` whose name recurs, in the order (name, place), and small
    numbers for their names."""
    order = np.argsort(names, kind="stable")
    sort = names[order]
    group = np.cumsum(np.append(False, sort[1:] != sort[:-1])[: len(sort)])
    keep = np.bincount(group)[group] > 1
    return at[order[keep]], group[keep]


def _seeds(at: np.ndarray, group: np.ndarray, before: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of places of the same gram with low <= j - i < high and different
    words before them, a block of pairs a round: each place goes on to its next
    partner, and jumps over all that have the same word before them as itself."""
    n = len(at)
    word = before[at]
    # the next entry, in this order, with another gram or another word before it
    changes = np.flatnonzero(np.append((group[1:] != group[:-1]) | (word[1:] != word[:-1]), True)) + 1
    after = changes[np.searchsorted(changes, np.arange(n), side="right")]
    # the first partner far enough
    wide = int(at.max()) + high + 1
    line = group * wide + at
    left = np.arange(n)
    right = np.maximum(left + 1, np.searchsorted(line, line + low))
    while True:
        live = right < n
        left, right = left[live], right[live]
        live = (group[right] == group[left]) & (at[right] - at[left] < high)
        left, right = left[live], right[live]
        if not len(left):
            return
        same = word[right] == word[left]
        yield at[left[~same]], at[right[~same]]
        right = np.where(same, after[right], right + 1)


def _agree(ids: np.ndarray, i: int, j: int) -> int:
    """Number of equal words from i and j on."""
    n, done, step = len(ids) - j, 0, 64
    while done < n:
        size = min(step, n - done)
        unequal = ids[i + done : i + done + size] != ids[j + done : j + done + size]
        k = int(unequal.argmax())
        if unequal[k]:
            return done + k
        done, step = done + size, step * 2
    return n


def periodic_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) > n - GRAM:  # a run repeats at least six words
        return []
    before = np.append(-1, ids[:-1])
    names = _grams(ids)
    at, group = _repeated(names, np.arange(len(names)))
    k, low, high = GRAM, 1, LEAST
    covered: dict[int, int] = {}
    started: dict[int, list[tuple[int, int]]] = {}
    while len(at):
        found = [p for p in _seeds(at, group, before, low, high)]
        if found:
            left, right = (np.concatenate(x) for x in zip(*found, strict=True))
            # a smaller lag first, so that its multiples are left out
            order = np.lexsort((left, right - left))
            for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
                lag = j - i
                if covered.get(lag, -1) > i or any(lag % q == 0 and j < end for q, end in started.get(i, ())):
                    continue
                size = _agree(ids, i, j)
                covered[lag] = i + size
                if size >= lag and size + lag >= LEAST:
                    started.setdefault(i, []).append((lag, i + lag + size))
        if k == GRAM:
            low, high = LEAST, 2 * LEAST
        else:
            low, high = high, 2 * high
        if 2 * low > n:
            break
        # the next level's grams are two of this level's, side by side
        place = np.full(n + 1, -1, np.int64)
        place[at] = group
        at = np.sort(at)
        follow = place[np.minimum(at + k, n)]
        at, follow = at[follow >= 0], follow[follow >= 0]
        at, group = _repeated(place[at] * (n + 1) + follow, at)
        k *= 2
    return sorted((i, end - i, q) for i, runs in started.items() for q, end in runs)


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words but those after the first period of a run."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


RUNS = "struct<runs array<struct<start long, length long, period long>>, collapsed string>"


def with_runs(text: Column) -> Column:
    """``runs`` of a column of texts, by start, then period, in words of the text,
    and ``collapsed``: its words without repeats, joined by blanks. A null or empty
    text has no run and an empty ``collapsed``. Whole texts, of any length."""
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = pa.struct([("runs", pa.list_(triple)), ("collapsed", pa.string())])

    def find(texts: pa.Array) -> pa.Array:
        out = []
        for _, held in blocks(texts):
            for t in held:
                words = WORD.findall(t or "")
                runs = periodic_runs(words)
                out.append(([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], " ".join(collapsed(words, runs))))
        return pa.array([{"runs": r, "collapsed": c} for r, c in out], kind)

    return F.arrow_udf(find, RUNS)(text)


def planted(docs: DataFrame) -> DataFrame:
    """The contract's ``doc_id`` and ``text``: where crc32 of the id ends in 0, the
    words from place a on are those of the first p places from there, over and over.
    A null id leaves its text as it is. Each step is a column of its own, so that it
    is computed once a row, not once a word."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce(docs["text"], F.lit("")), F.lit(C.WORD), F.lit(0))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    rows = rows.withColumn("_n", F.size("_w").cast("long")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    a, p = F.col("_a"), F.col("_p")
    altered = F.transform("_w", lambda w, i: F.when(i < a, w).otherwise(F.get("_w", (a + (i - a) % p).cast("int"))))
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(altered, " ")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the runs of every document. Rows that repeat an id each get a
    row."""
    rows = planted(C.table(spark, sf_dir, "documents")).select("doc_id", with_runs(F.col("text")).alias("s"))
    runs = F.col("s.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("s.collapsed"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("b.start"), F.col("b.length"), -F.col("b.period")
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
