"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) of at least
``least_length`` and 2q words, which no neighbouring word extends.

* Masking.  A run of length L overlaps its own shift by L - q words, and with L >= max(least_length, 2q) the overlap has at
  least k = ceil(least_length / 2) words, whatever q is.  The run's first and last L - q words cover it, so each of its
  words lies in a k-gram that occurs again in the document.  Words outside such k-grams can't belong to a run: they go, and
  the stretches between them, if of ``least_length`` words or more, are the segments to look at.  k-grams are compared by a
  64-bit hash; a collision lets a word survive, never takes one away.
* Main-Lorentz on a segment.  It is halved again and again; a run that crosses a middle and lies within the node is found
  from the pair of positions one period apart of which one is the middle, by how far the words after and before the
  pair agree.  All nodes of a depth and all periods are looked at together; pairs of which neither the words
  just before nor those just after agree can't reach the overlap and go first.  Extensions are exact: they descend over
  names of stretches of 2^t words.  A stretch found for several periods has the smallest of them.

The work of a segment of m words is O(m log^2 m) at worst, memory O(m log m); each text is worked on by itself.

Defined results: a null or empty text has no words and no runs; texts of any length are searched whole; repeated rows give a
row each; a null id is kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, table

#: Words: all but space and the five control characters from tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
LEAST_LENGTH = 12
NONE = np.empty((0, 3), np.int64)


def least_overlap(least_length: int) -> int:
    """How many words at least a run shares with its shift by one period: the smallest max(least_length - q, q)."""
    return (least_length + 1) // 2


def word_ids(words: list[str]) -> np.ndarray:
    """A number for each different word."""
    known = dict(zip(words, range(len(words))))
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def surviving_segments(ids: np.ndarray, least_length: int) -> list[tuple[int, int]]:
    """Stretches (start, end) whose words all lie in k-grams that occur again, long enough for a run."""
    k, n = least_overlap(least_length), len(ids)
    if n < least_length:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    grams = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : n - k + 1 + j]
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return []
    at = np.minimum(np.searchsorted(again, grams), len(again) - 1)
    first = np.flatnonzero(again[at] == grams)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + k, -1)
    inside = np.concatenate([[False], np.cumsum(change[:n]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    return [(int(a), int(b)) for a, b in edges if b - a >= least_length]


class Extensions:
    """How far two positions of a word sequence agree forwards and backwards, for many pairs at once."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.names = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
        while 2 << len(self.names) - 1 <= self.n:
            last, half = self.names[-1], 1 << len(self.names) - 1
            pairs = last[:-half] * (self.n + 1) + last[half:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        self.names = [x.astype(np.int32) for x in self.names]

    def _same(self, t: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the 2^t words from i and from j are the same; False where either leaves the sequence (i < j)."""
        if t >= len(self.names):
            return np.zeros(len(i), bool)
        names = self.names[t]
        inside = (i >= 0) & (j < len(names))
        return inside & (names[np.where(inside, i, 0)] == names[np.where(inside, j, 0)])

    def near(self, i: np.ndarray, j: np.ndarray, overlap: int) -> np.ndarray:
        """Pairs that can agree in ``overlap`` words: half of them lie before or after the pair, tested to a power of two."""
        t = ((overlap + 1) // 2).bit_length() - 1
        return self._same(t, i, j) | self._same(t, i - (1 << t), j - (1 << t))

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for t in range(len(self.names) - 1, -1, -1):
            out += self._same(t, i + out, j + out).astype(np.int64) << t
        return out

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for t in range(len(self.names) - 1, -1, -1):
            out += self._same(t, i - out - (1 << t), j - out - (1 << t)).astype(np.int64) << t
        return out


def _smallest_periods(found: np.ndarray) -> np.ndarray:
    """Of equal stretches (start, length, period) the one with the smallest period, by start, then period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    same = (found[1:, :2] == found[:-1, :2]).all(1)
    return found[np.concatenate([[True], ~same])] if len(found) else found


def segment_runs(ids: np.ndarray, least_length: int, block: int = 1 << 18) -> np.ndarray:
    """Rows (start, length, period) of all runs of a segment."""
    reach, found, overlap = Extensions(ids), NONE, least_overlap(least_length)
    nodes = np.array([[0, len(ids)]], np.int64)
    while len(nodes):
        middles = nodes.sum(1) // 2
        rights, lefts = nodes[:, 1] - middles, middles - nodes[:, 0]
        ends = np.cumsum(rights + lefts)
        for begin in range(0, int(ends[-1]), block):  # periods of all nodes one after the other: to the right, then to the left
            at = np.arange(begin, min(begin + block, int(ends[-1])))
            node = np.searchsorted(ends, at, side="right")
            at = at - ends[node] + rights[node] + lefts[node]
            right = at < rights[node]
            i = np.where(right, middles[node], middles[node] - (at - rights[node]) - 1)
            j = np.where(right, middles[node] + at + 1, middles[node])
            close = reach.near(i, j, overlap)
            i, j = i[close], j[close]
            after, before = reach.forwards(i, j), reach.backwards(i, j)
            period, shared = j - i, after + before
            run = (shared >= period) & (shared + period >= least_length)
            if run.any():
                rows = np.stack([i[run] - before[run], shared[run] + period[run], period[run]], 1)
                found = _smallest_periods(np.concatenate([found, rows]))
        halves = np.concatenate([np.stack([nodes[:, 0], middles], 1), np.stack([middles, nodes[:, 1]], 1)])
        nodes = halves[halves[:, 1] - halves[:, 0] >= least_length]
    return found


def runs_of(words: list[str], least_length: int = LEAST_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    if len(words) < least_length:
        return NONE
    ids = word_ids(words)
    parts = [segment_runs(ids[a:b], least_length) + [a, 0, 0] for a, b in surviving_segments(ids, least_length)]
    rows = np.concatenate(parts) if parts else NONE
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapse(words: list[str], runs: np.ndarray) -> str:
    """The words, one space apart, without those that some run holds after its first period."""
    if not len(runs):
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _search(least_length: int):
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for begin in range(0, len(ids), 256):
                found, sizes, kept = [], [0], []
                for text in texts.slice(begin, 256):
                    words = WORD.findall(text.as_py())
                    runs = runs_of(words, least_length)
                    found.append(runs)
                    sizes.append(len(runs))
                    kept.append(collapse(words, runs))
                rows = np.concatenate(found)
                values = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(struct))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([ids.slice(begin, 256), lists, pa.array(kept, pa.string())], ["id", "runs", "collapsed"])

    return search


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """A row (id, runs, collapsed) for each row: its runs by start and period, and its words without their repetitions."""
    if least_length < 4:
        raise ValueError("least_length must be 4 or more")
    schema = "id long, runs array<struct<start:long, length:long, period:long>>, collapsed string"
    return id_and_text(docs, id_col, text_col).mapInArrow(_search(least_length), schema)


def longest(runs: Column) -> Column:
    """The run with the greatest length; of equal ones that of the smallest start, then period."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("under"))))
    return F.struct((-best["before"]).alias("start"), best["length"].alias("length"), (-best["under"]).alias("period"))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text) in which one text in ten, by the checksum h of its id, repeats itself from one word on.

    With g = h / 10 and n words the word i from a = g % n on becomes word a + (i - a) % p, where p = 1 + (n - a) / (3 + g % 8).
    A null id plants nothing.
    """
    h = F.crc32(F.col("id").cast("string").cast("binary"))
    rows = id_and_text(docs, id_col, text_col).withColumn("h", h)
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))))
    rows = rows.withColumns({"n": F.size("words"), "g": F.floor(F.col("h") / 10)})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    once = F.slice("words", F.col("a") + 1, F.col("p"))
    many = F.flatten(F.array_repeat(once, F.ceil(left / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(many, F.lit(1), left)), " ")
    return rows.select("id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), "id")
    best = F.when(F.size("runs") > 0, longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
