"""A hashed maximum-entropy language model with a class-factored softmax.

    P(word | history) = P(class | history) * P(word | class, history)

P(class | history) is a softmax over hashed features of the history: the word before (n-gram), the class of the word two
before (skip), and the pair of both classes.  P(word | class, history) is a softmax within the class,

    p(word) * exp(g1(word, slot of the word before) + g2(word, slot of the word two before)) / Z(class, slot, slot)

with p the word's smoothed share of its class (room is kept for one unknown word) and hashed n-gram and skip features of
every word, rare ones too: their number grows with the vocabulary.  A feature's value is the log of how much more often
than its class the word follows the slot, f = log((n + 1) / (c * share + 1)); its weight is shared by the words of a band of
frequency.  As a slot is one of ``SLOTS_OF``, Z is exact: it is a table by class and both slots, summed over all words.

Both softmaxes are trained by distributed gradient updates: one pass turns the whole training text into counts of (history,
class) and of (word, slot); each update sums the partitions' gradients over these counts.  The weights of the words'
features maximise the deleted likelihood, in which a token is not among the counts that predict it; so text that repeats
itself, copies included, raises them, and text without such ties leaves them near zero.

Classes are topics times three bands of frequency.  Topics are the clusters of all training documents' letter triples
(hashed, projected, k-means in distributed rounds); a head word has the topic in which it stands out most, words that are
not among the ``head`` most frequent that of their last letters.

Scoring is done in sparse numpy batches.  Counts and features of head words are broadcast (``head`` words at most); all
other words are joined with theirs by a shuffle.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end token a document.

Defined results: a null or empty text is the end token alone; a null id counts as training text; repeated rows are
learnt from and scored each; with no training text every word is unknown; an empty table gives an empty result; very long
texts are read whole; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_scratch, id_and_text, materialise

TOPICS, FREQUENT, OWN_ID = 12, 64, 1000
CLASSES = 1 + TOPICS * 3  # the end, and each topic's frequent, other head and rare words
SLOTS = 8192
ALPHA = 0.1
#: Ids of the word before: frequent words their own, others that of their class, then the start.
BEFORE = OWN_ID + CLASSES + 1
#: Slots of a word as the history of another; the start of a text has slot 0.
SLOTS_OF = 16
#: Lower ends of the bands of frequency that share a weight.
BANDS = np.array([0, 2, 3, 5, 9, 33, 257, 4097])
DIMS, TRIPLES = 24, 512


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def slot_of(token: bytes) -> int:
    return zlib.crc32(token) % SLOTS_OF


class Words(dict):
    """Token -> place among the head words, or -1 - (class * SLOTS_OF + slot) for others."""

    def __init__(self, head: list[bytes], suffixes: dict[bytes, int]):
        super().__init__((w, i) for i, w in enumerate(head))
        self.suffixes = suffixes

    def __missing__(self, token: bytes) -> int:
        return -1 - ((3 + 3 * self.suffixes.get(token[-3:], 0)) * SLOTS_OF + slot_of(token))


def history(ids: np.ndarray, head_class: np.ndarray, head_slot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(class, id of the word before, class of the word two before, slots of both) of each token, the end included."""
    n = len(ids)
    known = ids >= 0
    at = np.where(known, ids, 0)
    cls = np.zeros(n + 1, np.int64)
    cls[:n] = np.where(known, head_class[at], (-1 - ids) // SLOTS_OF)
    slot = np.where(known, head_slot[at], (-1 - ids) % SLOTS_OF)
    before = np.full(n + 1, BEFORE - 1, np.int64)
    before[1:] = np.where(known & (ids < OWN_ID), ids, OWN_ID + cls[:n])
    two = np.full(n + 1, CLASSES, np.int64)
    two[2:] = cls[: max(0, n - 1)]
    s1, s2 = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    s1[1:] = slot
    s2[2:] = slot[: max(0, n - 1)]
    return cls, before, two, s1, s2


def slots(before: np.ndarray, two: np.ndarray, before_class: np.ndarray) -> np.ndarray:
    """Hashed features of histories, one row each: bias, n-gram, skip, pair of classes."""
    raw = np.stack([np.zeros_like(before), 1 + before, 5_000 + two, 10_000 + before_class[before] * (CLASSES + 1) + two], axis=1).astype(np.uint64)
    return ((raw * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)).astype(np.int64)  # 13 bits


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


# ---- topics


def signature(raw: bytes) -> np.ndarray:
    """A text's hashed letter triples, projected."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(DIMS, np.float32)
    mixed = a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA6B) ^ a[2:] * np.uint32(0xC2B2AE35)
    v = np.sqrt(np.bincount(mixed >> np.uint32(23), minlength=TRIPLES))
    return (v @ _projection / np.sqrt(len(a) - 2)).astype(np.float32)


_projection = np.random.default_rng(17).normal(size=(TRIPLES, DIMS)) / np.sqrt(DIMS)


def _sums(df: DataFrame, work, size: int) -> np.ndarray:
    """``work(rows of signatures)``, a vector of ``size``, summed over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += work(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "x"])

    out = np.zeros(size)
    for r in df.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # ``size`` rows
        out[r["at"]] = r["x"]
    return out


def topic_centres(learnt: DataFrame, rounds: int = 8) -> np.ndarray:
    """Centres of TOPICS clusters of all documents: k-means from both ends of the main axes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [signature(x.as_py().lower()) for x in batch.column(0).slice(at, 512).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float32()))], ["v"])

    signs = materialise(learnt.select("text").mapInArrow(sign, "v array<float>"), "lm-signatures")
    moments = _sums(signs, lambda x: np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel())), 1 + DIMS + DIMS * DIMS)
    n = max(moments[0], 1)
    mean = moments[1 : 1 + DIMS] / n
    spread, axes = np.linalg.eigh(moments[1 + DIMS :].reshape(DIMS, DIMS) / n - np.outer(mean, mean))
    ends = [sign_ * np.sqrt(max(spread[-1 - i], 0)) * axes[:, -1 - i] for i in range(TOPICS // 2) for sign_ in (1, -1)]
    centres = mean + np.array(ends)

    def assigned(x: np.ndarray) -> np.ndarray:
        of = nearest_topic(x, centres)
        sums = np.zeros((TOPICS, DIMS + 1))
        np.add.at(sums, of, np.hstack([x, np.ones((len(x), 1))]))
        return sums.ravel()

    for _ in range(rounds):
        sums = _sums(signs, assigned, TOPICS * (DIMS + 1)).reshape(TOPICS, DIMS + 1)
        many = sums[:, -1:]
        centres = np.where(many > 0, sums[:, :-1] / np.maximum(many, 1), centres)
    drop_scratch(signs)
    return centres


def nearest_topic(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


# ---- words and their features


def features(n: np.ndarray, c: np.ndarray, share: np.ndarray) -> np.ndarray:
    return np.log((n + 1) / (c * share + 1))


def band(c: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, c, "right") - 1


def slot_sums(cls: np.ndarray, c: np.ndarray, n1: np.ndarray, n2: np.ndarray, many: np.ndarray, room: np.ndarray, shares: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What ``many`` words of each row add to Z - 1: by class and both slots."""
    out = np.zeros((CLASSES, SLOTS_OF, SLOTS_OF))
    p = many * (c + ALPHA) / room[cls]
    over = [np.exp(weights[k][band(c)][:, None] * features(n, c[:, None], shares[k][cls])) - 1 for k, n in enumerate((n1, n2))]
    for k in np.unique(cls):
        of = cls == k
        one, two, share = over[0][of], over[1][of], p[of]
        out[k] = (share @ one)[:, None] + (share @ two)[None, :] + (share[:, None] * one).T @ two
    return out


def slot_slopes(cls: np.ndarray, c: np.ndarray, n1: np.ndarray, n2: np.ndarray, many: np.ndarray, room: np.ndarray, shares: np.ndarray, weights: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """For each feature and band: its sum over the tokens without themselves, its expected sum, and its expected square; then the likelihood's part.

    ``rate``: tokens of a class and both slots over Z.
    """
    out = np.zeros((2, len(BANDS), 3))
    like = 0.0
    p = (many * (c + ALPHA) / room[cls])[:, None]
    f = [features(n, c[:, None], shares[k][cls]) for k, n in enumerate((n1, n2))]
    e = [np.exp(weights[k][band(c)][:, None] * f[k]) for k in (0, 1)]
    expected = [np.zeros_like(e[0]), np.zeros_like(e[0])]
    for k in np.unique(cls):
        of = cls == k
        expected[0][of] = p[of] * e[0][of] * (e[1][of] @ rate[k].T)
        expected[1][of] = p[of] * e[1][of] * (e[0][of] @ rate[k])
    for k, n in enumerate((n1, n2)):
        without = features(np.maximum(n - 1, 0), np.maximum(c - 1, 0)[:, None], shares[k][cls])
        bands, less = band(c), band(np.maximum(c - 1, 0))
        seen = many * (n * without).sum(1)
        out[k, :, 0] = np.bincount(less, seen, len(BANDS))
        out[k, :, 1] = np.bincount(bands, (expected[k] * f[k]).sum(1), len(BANDS))
        out[k, :, 2] = np.bincount(bands, (expected[k] * f[k] ** 2).sum(1), len(BANDS))
        like += float((weights[k][less] * seen).sum())
    return np.append(out.ravel(), like)


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SLOTS_OF).astype(float)


def _flush(tally: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    found = np.flatnonzero(tally)
    for at in range(0, len(found), 50_000):
        part = found[at : at + 50_000]
        yield _rows(kind, pa.array(part), pa.array(tally[part].astype(np.int64)))


def _rows(kind: int, key: pa.Array, n: pa.Array | None = None, word: pa.Array | None = None, counts: pa.Array | None = None) -> pa.RecordBatch:
    size = len(key)
    n, word, counts = (pa.nulls(size, t) if x is None else x for x, t in ((n, pa.int64()), (word, pa.string()), (counts, pa.binary())))
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), key, n, word, counts], ["kind", "key", "n", "word", "counts"])


HISTORY, HEAD, RARE, JOINT = range(4)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = 100_000, updates: int = 6) -> dict:
    """The model, learnt from the documents that are not held out, and the table of words that are not among the head."""
    spark = docs.sparkSession
    learnt = id_and_text(docs, id_col, text_col).where(~held_out(F.col("id"))).select("text")
    centres = topic_centres(learnt)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: list[Counter] = [Counter() for _ in range(TOPICS)]
        ends = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for topic, tally in enumerate(tallies):
                words, n = list(tally), np.fromiter(tally.values(), np.int64, len(tally))
                for at in range(0, len(words), 50_000):
                    part = pa.array(words[at : at + 50_000], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(part), topic, np.int32)), pa.array(n[at : at + 50_000])], ["word", "topic", "c"])
                tally.clear()

        for batch in batches:
            for value in batch.column(0).cast(pa.large_binary()):
                raw = value.as_py().lower()
                tallies[int(nearest_topic(signature(raw)[None, :], centres)[0])].update(raw.split())
                ends += 1
            if sum(map(len, tallies)) > 300_000:
                yield from emit()
        yield from emit()
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([0], pa.int32()), pa.array([ends])], ["word", "topic", "c"])  # no word is empty

    parts = materialise(learnt.mapInArrow(count, "word string, topic int, c long"), "lm-parts")
    ends = parts.where("word = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    counts = materialise(parts.where("word <> ''").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    sums = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    n_types, n_tokens = sums[0] + (ends > 0), sums[1] + ends
    # the least count of which there are at most ``head`` words; counts by count are few
    least, taken = 1 << 62, 0
    by_count = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))
    for r in by_count.toLocalIterator():
        taken += r.n
        if taken > head:
            break
        least = r.c
    top = counts.where(F.col("c") >= least)
    listed = top.orderBy(F.desc("c"), "word").toArrow()
    head_words = [w.encode() for w in listed.column(0).to_pylist()]
    head_counts = listed.column(1).to_numpy().astype(np.int64)
    size = len(head_words)
    place = {w: i for i, w in enumerate(head_words)}
    topic_words = np.zeros((TOPICS, size))
    spread = parts.join(F.broadcast(top.select("word")), "word", "left_semi").groupBy("word", "topic").agg(F.sum("c").alias("c")).toArrow()  # TOPICS rows a head word
    for word, topic, c in zip(*(column.to_pylist() for column in spread.columns)):
        topic_words[topic, place[word.encode()]] = c
    # the topic in which a word stands out, by its share there; words share what is known of their last letters
    shares_of = (topic_words + 0.5) / (topic_words.sum(axis=1, keepdims=True) + 0.5 * max(size, 1))
    endings: dict[bytes, np.ndarray] = {}
    for i, w in enumerate(head_words):
        endings[w[-3:]] = endings.get(w[-3:], 0) + topic_words[:, i]
    suffixes = {s: int(v.argmax()) for s, v in endings.items()}
    head_class = np.zeros(max(size, 1), np.int64)
    seen = [0] * TOPICS
    for i in range(size):
        best = topic_words[:, i] * (1 + 1e-3 * shares_of[:, i] / shares_of[:, i].max())
        topic = int(best.argmax())
        head_class[i] = 1 + 3 * topic + (0 if seen[topic] < FREQUENT else 1)
        seen[topic] += 1
    head_slot = np.array([slot_of(w) for w in head_words] or [0], np.int64)
    before_class = np.zeros(BEFORE, np.int64)
    before_class[: min(size, OWN_ID)] = head_class[: min(size, OWN_ID)]
    before_class[OWN_ID : OWN_ID + CLASSES] = np.arange(CLASSES)
    before_class[-1] = CLASSES
    shape = (BEFORE, CLASSES + 1, CLASSES)
    words = spark.sparkContext.broadcast((head_words, suffixes, head_class, head_slot))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_list, ends_in, classes, own_slot = words.value
        place, tally = Words(head_list, ends_in), np.zeros(int(np.prod(shape)), np.int32)
        one, two_, joint = np.zeros(size * SLOTS_OF, np.uint32), np.zeros(size * SLOTS_OF, np.uint32), np.zeros(CLASSES * SLOTS_OF**2, np.int64)
        pending: tuple[list, ...] = ([], [], [], [])
        rare: Counter = Counter()
        held = 0

        def settle() -> None:
            for into, keys in zip((tally, one, two_, joint), pending):
                if keys:
                    into += np.bincount(np.concatenate(keys), minlength=len(into)).astype(into.dtype)
                    keys.clear()

        def emit() -> Iterator[pa.RecordBatch]:
            items = list(rare.items())
            rare.clear()
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield _rows(RARE, pa.array([k[1] for k, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64()), pa.array([k[0] for k, _ in part], pa.binary()).cast(pa.string()))

        for batch in batches:
            for value in batch.column(0).cast(pa.large_binary()):
                tokens = value.as_py().lower().split()
                ids = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
                cls, before, two, s1, s2 = history(ids, classes, own_slot)
                known = np.flatnonzero(ids >= 0)
                pending[0].append((before * shape[1] + two) * shape[2] + cls)
                pending[1].append(ids[known] * SLOTS_OF + s1[known])
                pending[2].append(ids[known] * SLOTS_OF + s2[known])
                pending[3].append((cls * SLOTS_OF + s1) * SLOTS_OF + s2)
                others = np.flatnonzero(ids < 0)
                if len(others):
                    rare.update(zip(map(tokens.__getitem__, others.tolist()), (s1[others] * SLOTS_OF + s2[others]).tolist()))
                held += len(cls)
                if held > 500_000:
                    settle()
                    held = 0
            if len(rare) > 300_000:
                yield from emit()
        settle()
        yield from emit()
        yield from _flush(tally, HISTORY)
        yield from _flush(joint, JOINT)
        both = np.hstack([one.reshape(size, SLOTS_OF), two_.reshape(size, SLOTS_OF)])
        found = np.flatnonzero(both.any(axis=1))
        for at in range(0, len(found), 20_000):
            part = found[at : at + 20_000]
            ends_at = pa.py_buffer(np.arange(0, 4 * 2 * SLOTS_OF * len(part) + 1, 4 * 2 * SLOTS_OF, dtype=np.int32).tobytes())
            yield _rows(HEAD, pa.array(part), counts=pa.Array.from_buffers(pa.binary(), len(part), [None, ends_at, pa.py_buffer(both[part].tobytes())]))

    seen_in = materialise(learnt.mapInArrow(contexts, "kind int, key long, n long, word string, counts binary"), "lm-contexts")
    # at most as many rows as there are histories and classes, whatever the size of the corpus
    summed = seen_in.where(F.col("kind") == HISTORY).groupBy("key").agg(F.sum("n").alias("n"))
    examples = materialise(summed.repartition(8, F.col("key").cast("string")), "lm-examples")
    best, likelihoods = _train_classes(spark, examples, shape, before_class, updates)
    everything = np.stack(np.meshgrid(np.arange(shape[0]), np.arange(shape[1]), indexing="ij"), axis=-1).reshape(-1, 2)
    table = (log_softmax(best[slots(everything[:, 0], everything[:, 1], before_class)].sum(axis=1)) / np.log(10)).astype(np.float32)

    # every word with its counts by slot: head words by their place, others by themselves
    joint = np.zeros(CLASSES * SLOTS_OF**2)
    for key, n in seen_in.where(F.col("kind") == JOINT).groupBy("key").agg(F.sum("n")).collect():  # a bounded table
        joint[key] = n
    joint = joint.reshape(CLASSES, SLOTS_OF, SLOTS_OF)
    totals = joint.sum(axis=(1, 2))[:, None] + SLOTS_OF
    shares = np.stack([(joint.sum(axis=2) + 1) / totals, (joint.sum(axis=1) + 1) / totals])
    pairs = seen_in.where(F.col("kind") == RARE).repartition("word").groupBy("word", "key").agg(F.sum("n").alias("n"))
    by_word = pairs.groupBy("word").agg(F.collect_list(F.struct(F.col("key").cast("int").alias("slot"), "n")).alias("found"))

    def laid_rows(words_: pa.Array, ids: np.ndarray, cls: np.ndarray, both: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.arange(0, len(ids) * SLOTS_OF + 1, SLOTS_OF, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(b.ravel().astype(np.int32))) for b in both]
        return pa.RecordBatch.from_arrays([words_, pa.array(ids), pa.array(cls.astype(np.int32)), pa.array(both[0].sum(axis=1).astype(np.int64)), *lists], ["word", "id", "cls", "c", "n1", "n2"])

    def lay_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, 2 * SLOTS_OF))
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, 2 * SLOTS_OF)
            np.add.at(total, batch.column(0).to_numpy(), values)
        found = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(found), 10_000):
            ids = found[at : at + 10_000]
            yield laid_rows(pa.nulls(len(ids), pa.string()), ids, words.value[2][ids], total[ids].reshape(-1, 2, SLOTS_OF).swapaxes(0, 1))

    def lay_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Words([], words.value[1])
        for batch in batches:
            found = batch.column(1)
            row = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
            flat = found.flatten()
            slot, n = flat.field("slot").to_numpy().astype(np.int64), flat.field("n").to_numpy()
            both = np.stack([np.bincount(row * SLOTS_OF + s, n, len(found) * SLOTS_OF) for s in (slot // SLOTS_OF, slot % SLOTS_OF)]).reshape(2, -1, SLOTS_OF)
            cls = np.array([(-1 - place[w]) // SLOTS_OF for w in batch.column(0).cast(pa.binary()).to_pylist()], np.int64)
            yield laid_rows(batch.column(0), np.full(len(found), -1), cls, both)

    schema = "word string, id long, cls int, c long, n1 array<int>, n2 array<int>"
    by_head = seen_in.where(F.col("kind") == HEAD).select("key", "counts").repartition("key").mapInArrow(lay_head, schema)
    laid = materialise(by_head.unionByName(by_word.mapInArrow(lay_others, schema)), "lm-words")
    tokens_of, types_of = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in laid.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        tokens_of[r["cls"]], types_of[r["cls"]] = r["c"], r["n"]
    tokens_of[0], types_of[0] = ends, 1 if ends else 0
    room = tokens_of + ALPHA * (types_of + 1)
    weights, rooms, slot_likelihoods = _train_words(laid, room, shares, joint, updates)
    # the head's features, as logarithms of base 10
    own = np.zeros((2, size, SLOTS_OF), np.float32)
    of_head = laid.where("id >= 0").select("id", "cls", "c", "n1", "n2").toArrow()  # the head at most
    for batch in of_head.to_batches():
        ids, cls, c = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
        for k in (0, 1):
            own[k, ids] = weights[k][band(c)][:, None] * features(_lists(batch.column(3 + k)), c[:, None], shares[k][cls]) / np.log(10)
    for done in (examples, seen_in, parts, counts):
        drop_scratch(done)
    return {
        "head": head_words, "head_counts": head_counts, "suffixes": suffixes, "head_class": head_class, "head_slot": head_slot, "table": table, "class_tokens": tokens_of,
        "class_types": types_of, "ends": ends, "n_tokens": n_tokens, "n_types": n_types, "others": laid.where("id < 0").select("word", "c", "n1", "n2"), "shares": shares,
        "weights": weights, "rooms": rooms, "own": own, "likelihoods": likelihoods, "slot_likelihoods": slot_likelihoods, "joint": joint,
    }


def _train_classes(spark, examples: DataFrame, shape: tuple[int, ...], before_class: np.ndarray, updates: int) -> tuple[np.ndarray, list[float]]:
    """Weights of the softmax over classes, and the likelihood at each update."""

    def update(weights: np.ndarray | None) -> tuple[np.ndarray, float]:
        """Gradient of the log-likelihood (or, without weights, observed feature sums), and the log-likelihood."""
        shipped = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, total, like = shipped.value, np.zeros((SLOTS, CLASSES)), 0.0
            for batch in batches:
                keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float)
                y, rest = keys % shape[2], keys // shape[2]
                contexts_, inverse = np.unique(rest, return_inverse=True)
                f = slots(contexts_ // shape[1], contexts_ % shape[1], before_class)
                change = np.zeros((len(contexts_), CLASSES))
                np.add.at(change, (inverse, y), n)
                if w is not None:
                    logp = log_softmax(w[f].sum(axis=1))
                    like += float((change * logp).sum())
                    change = change - change.sum(axis=1, keepdims=True) * np.exp(logp)
                for i in range(f.shape[1]):
                    np.add.at(total, f[:, i], change)
            at = np.append(np.flatnonzero(np.abs(total).sum(axis=1)), -1)  # the last row is the partition's likelihood
            values = [*total[at[:-1]], np.full(CLASSES, like)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values, pa.list_(pa.float64()))], ["slot", "g"])

        parts = examples.mapInArrow(run, "slot long, g array<double>").toArrow()  # 8 partitions of SLOTS rows at most
        out, like = np.zeros((SLOTS, CLASSES)), 0.0
        if parts.num_rows:
            at, values = parts.column(0).to_numpy(), parts.column(1).combine_chunks().flatten().to_numpy().reshape(-1, CLASSES)
            np.add.at(out, at[at >= 0], values[at >= 0])
            like = float(values[at < 0, 0].sum())
        shipped.unpersist()
        return out, like

    observed, _ = update(None)
    bias = slots(np.array([0]), np.array([0]), before_class)[0, 0]
    prior = (observed[bias] + 1) / (observed[bias] + 1).sum()
    # start: a part of what each feature says by itself
    weights = 0.4 * np.log((observed + 20 * prior) / (observed.sum(axis=1, keepdims=True) + 20) / prior)
    weights[bias] = np.log(prior)
    evidence = observed.sum(axis=1, keepdims=True) + 100
    step, best, best_like, slope = 0.4, weights, -np.inf, None
    likes = []
    for _ in range(updates):
        gradient, like = update(weights)
        likes.append(like)
        if like >= best_like:
            best, best_like, slope, step = weights, like, gradient, step * 1.3
        else:
            step *= 0.4
        weights = best + step * slope / evidence / np.maximum(prior, 0.01)
    return best, likes


def _train_words(laid: DataFrame, room: np.ndarray, shares: np.ndarray, joint: np.ndarray, updates: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(weights of the words' features by kind and band, log10 Z by class and slots, deleted likelihood at each update)."""
    spark = laid.sparkSession
    # most rare words look alike: they count together
    columns = materialise(laid.groupBy("cls", "c", "n1", "n2").agg(F.count("*").alias("many")), "lm-word-kinds")

    def total(work, size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                for at in range(0, batch.num_rows, 20_000):
                    part = batch.slice(at, 20_000)
                    cls, c, many = (part.column(i).to_numpy().astype(t) for i, t in ((0, np.int64), (1, float), (4, float)))
                    out += work(cls, c, _lists(part.column(2)), _lists(part.column(3)), many).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out)], ["at", "x"])

        out = np.zeros(size)
        for r in columns.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # ``size`` rows
            out[r["at"]] = r["x"]
        return out

    def rooms_of(weights: np.ndarray) -> np.ndarray:
        return 1 + total(lambda *words: slot_sums(*words, room, shares, weights), joint.size).reshape(joint.shape)

    weights = np.zeros((2, len(BANDS)))
    best, best_like, rooms, likes, step, move = weights, -np.inf, np.ones(joint.shape), [], 1.0, weights
    for _ in range(updates):
        z = rooms_of(weights)
        rate = joint / z
        sums = total(lambda *words: slot_slopes(*words, room, shares, weights, rate), 2 * len(BANDS) * 3 + 1)  # noqa: B023
        like = sums[-1] - float((joint * np.log(z)).sum())
        likes.append(like)
        if like >= best_like:
            best, best_like, rooms, step = weights, like, z, min(1.0, step * 2)
            seen, expected, square = np.moveaxis(sums[:-1].reshape(2, len(BANDS), 3), 2, 0)
            move = np.clip((seen - expected) / (square + 1), -1, 1)
        else:
            step *= 0.4
        weights = np.clip(best + step * move, -0.5, 6)
    drop_scratch(columns)
    return best, np.log10(rooms), likes


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, n_known, base_score, score); scores are log10 probabilities."""
    spark = docs.sparkSession
    room = np.log10(model["class_tokens"] + ALPHA * (model["class_types"] + 1))  # by class
    floor = float(np.log10(model["n_tokens"] + ALPHA * (model["n_types"] + 1)))
    counts = model["head_counts"]
    size = len(counts)
    head_class = model["head_class"]
    base_of = np.log10(counts + ALPHA) - floor
    own_of = np.log10(counts + ALPHA) - room[head_class[:size]]
    end = np.log10(model["ends"] + ALPHA)
    shipped = spark.sparkContext.broadcast((model["head"], model["suffixes"], head_class, model["head_slot"], base_of, own_of, model["table"], model["own"], model["rooms"]))
    shape = (BEFORE, CLASSES + 1)
    end_known = int(model["ends"] > 0)
    schema = "key long, id long, n_tokens long, n_known long, base double, own double, rare array<struct<word:string,at:int,tf:int>>"
    kind = pa.list_(pa.struct([("word", pa.string()), ("at", pa.int32()), ("tf", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head_list, suffixes, classes, own_slot, base, own, table, features_of, rooms = shipped.value
        place, key = Words(head_list, suffixes), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: tuple[list, ...] = ([], [], [], [], [])
                lengths, words, ats, tfs = [], [], [], []
                for value in part.column(1).cast(pa.large_binary()):
                    tokens = value.as_py().lower().split()
                    ids = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
                    cls, before, two, s1, s2 = history(ids, classes, own_slot)
                    known, others = np.flatnonzero(ids >= 0), np.flatnonzero(ids < 0)
                    found = ids[known]
                    choice = float(table[before * shape[1] + two, cls].sum(dtype=np.float64))
                    words_part = own[found].sum() + (features_of[0][found, s1[known]] + features_of[1][found, s2[known]]).sum(dtype=np.float64) - rooms[cls[known], s1[known], s2[known]].sum()
                    code = (cls[others] * SLOTS_OF + s1[others]) * SLOTS_OF + s2[others]
                    tally = Counter(zip(map(tokens.__getitem__, others.tolist()), code.tolist()))
                    lengths.append(len(tally))
                    for (w, c), n in tally.items():
                        words.append(w)
                        ats.append(c)
                        tfs.append(n)
                    row = (key, len(tokens) + 1, len(known) + end_known, float(base[found].sum()) + end - floor, choice + float(words_part) + end - room[0])
                    for column, x in zip(out, row):
                        column.append(x)
                    key += 1
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                arrays = [pa.array(c, t) for c, t in zip(out, types)]
                flat = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(ats, pa.int32()), pa.array(tfs, pa.int32())], ["word", "at", "tf"])
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), flat).cast(kind)
                yield pa.RecordBatch.from_arrays([arrays[0], part.column(0), *arrays[1:], rare], ["key", "id", "n_tokens", "n_known", "base", "own", "rare"])

    scored = materialise(id_and_text(docs, id_col, text_col).mapInArrow(run, schema), "lm-scored")
    others = scored.select("key", F.explode("rare").alias("r")).select("key", F.col("r.word").alias("word"), F.col("r.at").alias("at"), F.col("r.tf").alias("tf"))
    c = F.coalesce("c", F.lit(0))
    listed = lambda x: F.lit([float(v) for v in np.asarray(x).ravel()])
    cls = F.floor(F.col("at") / SLOTS_OF**2).cast("int")
    slot = (F.pmod(F.floor(F.col("at") / SLOTS_OF), F.lit(SLOTS_OF)).cast("int"), F.pmod("at", F.lit(SLOTS_OF)))
    value = F.log10(c + F.lit(ALPHA))
    of_class = F.get(listed(room), cls) + F.get(listed(model["rooms"]), F.col("at"))
    nr = F.lit(len(BANDS) - 1)
    for i in range(len(BANDS) - 1, 0, -1):
        nr = F.when(c < F.lit(int(BANDS[i])), i - 1).otherwise(nr)
    feature = F.lit(0.0)
    for k, column in enumerate(("n1", "n2")):
        n = F.coalesce(F.get(column, slot[k]), F.lit(0))
        share = F.get(listed(model["shares"][k]), cls * SLOTS_OF + slot[k])
        feature = feature + F.when(c > 0, F.get(listed(model["weights"][k]), nr) * F.log10((n + 1) / (c * share + 1))).otherwise(0.0)
    joined = others.join(model["others"], "word", "left").groupBy("key").agg(
        F.sum(F.col("tf") * (value - F.lit(floor))).alias("rare_base"),
        F.sum(F.col("tf") * (value - of_class + feature)).alias("rare_own"),
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known"),
    )
    zero = F.lit(0.0)
    return scored.drop("rare").join(joined, "key", "left").select(
        "id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("own") + F.coalesce("rare_own", zero)).alias("score"),
    )


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return score(docs, model).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", F.lit(model["n_tokens"]).cast("long").alias("train_tokens"), "base_score", "score"
    )
