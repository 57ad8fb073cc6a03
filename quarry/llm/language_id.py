"""Language identification by a byte convolutional network trained in numpy.

The network reads the bytes of the lower-cased text in windows of ``WINDOW`` positions: a vector for each byte,
filters of several widths at every position, the greatest value of each filter in the window, a rectifier and a softmax
over the languages.  It is trained by Adam on windows of labelled texts: ``per_language`` distinct texts of each of the
``languages`` most frequent labels (the bounds of the sample, both parameters), four windows a text, some of them cut short
so that short texts are known too.  Copies of a text count once.

Scoring takes whole texts: windows tile the text without a gap, and filters read over their edges.  A filter of up to four
bytes is the sum of a table entry of its first two bytes and one of its last two, so a position costs two look-ups whatever
the width of the byte vectors.  The windows' log probabilities are averaged, weighted by their bytes.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be learnt; a
null label teaches nothing; a null id is kept and is not held out; repeated rows are predicted each; texts of any length are
read whole, in blocks; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import table

WINDOW = 256  # positions
DIMS = 8  # of a byte
#: Filters by width in bytes; none is wider than four.
FILTERS = {2: 8, 3: 12, 4: 12}
WIDEST = 4
UNKNOWN = "und"
BLOCK = 64  # windows looked at together


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _shape() -> tuple[int, np.ndarray]:
    """Number of filters, and which weights of each (position and dimension by filter) are inside its width."""
    widths = np.repeat(list(FILTERS), list(FILTERS.values()))
    inside = np.arange(WIDEST * DIMS)[:, None] < widths[None, :] * DIMS
    return len(widths), inside.astype(np.float32)


def softmax_log(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _cut(windows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A third of the windows is cut to a random length: what follows is zero."""
    out = windows.copy()
    lengths = np.where(rng.random(len(out)) < 0.33, np.exp(rng.uniform(np.log(6), np.log(WINDOW), len(out))), WINDOW)
    out[np.arange(WINDOW)[None, :] >= lengths[:, None]] = 0
    return out


def train(windows: np.ndarray, labels: np.ndarray, classes: int, updates: int = 1_200, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights of the network for windows (rows of bytes, zero beyond the end of a text) and their class numbers.

    Each update draws a batch in which all classes are as likely.
    """
    rng = np.random.default_rng(seed)
    filters, inside = _shape()
    weights = {
        "bytes": rng.normal(0, 0.5, (256, DIMS)).astype(np.float32),
        "filters": (rng.normal(0, 0.3, (WIDEST * DIMS, filters)) * inside).astype(np.float32),
        "floor": np.zeros(filters, np.float32),
        "out": rng.normal(0, 0.2, (filters, classes)).astype(np.float32),
        "base": np.zeros(classes, np.float32),
    }
    weights["bytes"][0] = 0
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    share = 1 / np.bincount(labels, minlength=classes)[labels]
    draw = rng.choice(len(windows), (updates, batch), p=share / share.sum())
    for step, pick in enumerate(draw, 1):
        slopes = gradient(weights, _cut(windows[pick], rng), labels[pick])
        now = rate * (1 - step / (updates + 1))
        for k, g in slopes.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            weights[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        weights["filters"] *= inside
        weights["bytes"][0] = 0
    return weights


def gradient(weights: dict[str, np.ndarray], windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the mean cross entropy; only the position where a filter is greatest has one."""
    m, (_, inside) = len(windows), _shape()
    flat = np.concatenate([windows, np.zeros((m, WIDEST - 1), np.uint8)], 1)
    seen = np.lib.stride_tricks.sliding_window_view(flat, WIDEST, 1)  # (m, WINDOW, WIDEST)
    x = weights["bytes"][seen].reshape(m, WINDOW, WIDEST * DIMS)
    height = x @ weights["filters"]  # window by window: products this small stay in one thread
    at = height.argmax(1)  # (m, filters)
    rows = np.arange(m)[:, None]
    peak = np.take_along_axis(height, at[:, None, :], 1)[:, 0] + weights["floor"]
    pooled = np.maximum(peak, 0)
    d_out = np.exp(softmax_log(pooled @ weights["out"] + weights["base"]))
    d_out[np.arange(m), labels] -= 1
    d_out /= m
    d_peak = (d_out @ weights["out"].T) * (peak > 0)
    best = x[rows, at]  # (m, filters, WIDEST * DIMS)
    d_bytes = np.zeros_like(weights["bytes"])
    back = d_peak[:, :, None] * weights["filters"].T[None]
    np.add.at(d_bytes, seen[rows, at].reshape(-1), back.reshape(-1, DIMS))
    d_bytes[0] = 0
    return {
        "bytes": d_bytes,
        "filters": np.einsum("mf,mfk->kf", d_peak, best).astype(np.float32) * inside,
        "floor": d_peak.sum(0),
        "out": pooled.T @ d_out,
        "base": d_out.sum(0),
    }


class Network:
    """The trained network as look-up tables of byte pairs."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        pairs = np.concatenate([np.repeat(weights["bytes"], 256, 0), np.tile(weights["bytes"], (256, 1))], 1)
        half = 2 * DIMS
        self.ahead, self.behind = pairs @ weights["filters"][:half], pairs @ weights["filters"][half:]

    def windows(self, flat: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log probabilities of windows laid one after the other, with WIDEST - 1 bytes or more behind the last.

        ``last`` tells which windows end a text; those end in WIDEST - 1 zeros or more, and nothing is read beyond.
        """
        many = len(last)
        out = np.empty((many, self.weights["out"].shape[1]), np.float32)
        for begin in range(0, many, BLOCK):
            some = min(BLOCK, many - begin)
            here = flat[begin * WINDOW : (begin + some) * WINDOW + WIDEST - 1].astype(np.intp)
            pair = here[:-1] * 256 + here[1:]
            ahead, behind = pair[: some * WINDOW].reshape(some, WINDOW), pair[2 : some * WINDOW + 2].reshape(some, WINDOW).copy()
            ends = last[begin : begin + some]
            behind[ends, 1 - WIDEST :] = 0
            ahead[ends, -1] = 0
            height = np.take(self.ahead, ahead.reshape(-1), 0)
            height += np.take(self.behind, behind.reshape(-1), 0)
            pooled = np.maximum(height.reshape(some, WINDOW, -1).max(1) + self.weights["floor"], 0)
            out[begin : begin + some] = softmax_log(pooled @ self.weights["out"] + self.weights["base"])
        return out

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of each text: the average of its windows' logarithms by their bytes, made to sum to one."""
        many = [-(-(len(t) + WIDEST - 1) // WINDOW) for t in texts]
        flat = np.frombuffer(b"".join([t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, many)]) + bytes(WIDEST), np.uint8)
        starts = np.concatenate([[0], np.cumsum(many)])[:-1]
        sizes = np.full(sum(many), WINDOW, np.float32)
        sizes[starts + many - 1] = [max(1, len(t) - (k - 1) * WINDOW) for t, k in zip(texts, many)]
        last = np.zeros(sum(many), bool)
        last[starts + many - 1] = True
        logs = self.windows(flat, last) * sizes[:, None]
        mean = np.add.reduceat(logs, starts, 0) / np.add.reduceat(sizes, starts)[:, None]
        return np.exp(softmax_log(mean.astype(np.float64)))


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int, languages: int) -> DataFrame:
    """Rows (lang, key, windows): at most ``per_language`` distinct texts of at most ``languages`` labels, four windows each."""
    text = F.lower(F.col(f"`{text_col}`").cast("string"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.col(f"`{label_col}`").cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    distinct = rows.groupBy("lang", "key").agg(F.min("id").alias("least"))
    frequent = F.broadcast(distinct.groupBy("lang").agg(F.count("*").alias("many")).orderBy(F.desc("many"), "lang").limit(languages))
    # a share of each label that holds some four times what is wanted, so that no task orders all texts of one
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    likely = distinct.join(frequent, "lang").withColumn("share", share).where(F.col("share") * F.col("many") < 4 * per_language)
    chosen = likely.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("share", "key")))
    chosen = F.broadcast(chosen.where(F.col("nth") <= per_language).select(F.col("lang").alias("of"), F.col("key").alias("its"), "least"))
    found = rows.join(chosen, (F.col("lang") == F.col("of")) & (F.col("key") == F.col("its")) & F.col("id").eqNullSafe(F.col("least")))
    raw = F.col("text").cast("binary")
    at = [(F.octet_length(raw) * part / 4).cast("int") + 1 for part in range(4)]
    return found.select("lang", "key", F.array(*[F.substring(raw, a, WINDOW) for a in at]).alias("windows")).dropDuplicates(["lang", "key"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 500, languages: int = 64) -> dict:
    """The languages and the weights, from labelled texts that are not held out."""
    rows = sorted(sample(docs, id_col, text_col, label_col, per_language, languages).collect(), key=lambda r: (r.lang, r.key))
    names = sorted({r.lang for r in rows})
    windows, labels = [], []
    for r in rows:
        for w in dict.fromkeys(bytes(w) for w in r.windows):
            windows.append(w.ljust(WINDOW, b"\0"))
            labels.append(names.index(r.lang))
    if not names:
        return {"languages": [], "weights": None}
    return {"languages": names, "weights": train(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW), np.array(labels), len(names))}


def _predict(model: dict):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, names = Network(model["weights"]), model["languages"]
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                texts = [t.as_buffer().to_pybytes() if t.is_valid else None for t in part.column(1)]
                known = [k for k, t in enumerate(texts) if t is not None]
                said, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    p = network.texts([texts[k] for k in known])
                    for k, best, value in zip(known, p.argmax(1).tolist(), p.max(1).tolist()):
                        said[k], score[k] = names[best], value
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score) for each input row."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(text.rlike(r"\p{L}"), F.lower(text)).cast("binary").alias("text"))
    if model["weights"] is None:
        return rows.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predict(model), "id long, lang_pred string, score double")


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
