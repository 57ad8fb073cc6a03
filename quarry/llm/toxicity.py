"""Toxicity by a learnt lexicon, Levenshtein automata and context windows.

Learning, on at most ``train_rows`` labelled documents (a bounded sample by hash of the id):

* words and word beginnings whose documents are toxic far more often than chance allows become the lexicon; all that
  are significant do.  Near copies count once: texts that share a band of min-hashes of their five-word shingles, and
  those reached over them, are one group, of whose toxic and clean texts one each counts (that of the smallest hash), so
  that a copied and edited text makes no terms of its words;
* words of clean documents that lie close to a term are kept as known words, which are not taken for misspellings;
* a logistic model weighs what is found.  Each fold of the sample is scored with the lexicon of the other folds; a group
  of near copies is in one fold.

Scoring: terms and stems form a trie; it is intersected with Levenshtein automata (one edit from four letters on, two
from eight on; a stem of six letters and more may begin a token with one edit) and the product is made deterministic
step by step as tokens are read, so a token costs a walk over known states.  Each match is scored in its context window:
matches between quotation marks, however far apart in their line, count as quotation, matches close to other matches
count more.

Defined results: an empty or null text has no match and gets the model's base score; a null id is kept; repeated rows
are scored each; labels are joined by id, the largest of several counts, null labels none; of several texts of one id
that of the smallest hash is learnt from (so the sample is bounded whatever an id holds); without both classes the
prior model is used; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, materialise
from .shingle_dedup import band_keys, shingles

WORD = re.compile(r"\w+")
#: Quotations of any length within a line, and quoted lines; each mark is looked at once.
QUOTED = re.compile(r"\"[^\"\n]++\"|“[^“”\n]++”|«[^«»\n]++»|„[^„“”\n]++[“”]|^[ \t]*>[^\n]*", re.M)
STEM_LENGTHS = range(4, 9)
WINDOW = 5  # tokens on either side
#: Least log odds of a term, and the share of the bar that a word must reach.
ODDS, WEAK = 2.5, 0.65
FOLDS = 4

#: Prior of the logistic model: base, all matches but quoted ones, misspelled matches, quoted matches, matches per token.
PRIOR = np.array([-2.5, 2.5, -0.1, 0.3, 1.0])
#: How strongly each weight is drawn to it: misspellings and quotations are too rare in labelled text to say much.
STRENGTH = np.array([1.0, 4.0, 10.0, 4.0, 1.0])


class _Side:
    """Levenshtein automata of entries read in one direction: their trie, determinised lazily.

    An entry is (word, term, edits, length of its first half, whether it is a stem).  Inside the first half a state may
    hold half of the edits only, so that most tokens leave the trie after some letters.
    """

    def __init__(self, entries: list[tuple[str, str, int, int, bool]]):
        self.nodes: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, int, bool]]] = [[]]
        self.most: list[int] = [0]  # edits that some term below a node allows there
        for word, term, allowed, half, stem in sorted(entries):
            at = 0
            for depth, ch in enumerate(word):
                self.most[at] = max(self.most[at], allowed // 2 if depth < half else allowed)
                if ch not in self.nodes[at]:
                    self.nodes[at][ch] = len(self.nodes)
                    self.nodes.append({})
                    self.ends.append([])
                    self.most.append(0)
                at = self.nodes[at][ch]
            self.most[at] = max(self.most[at], allowed)
            self.ends[at].append((term, allowed, stem))
        # edits that a node or a child allows: a state that has as many goes on by the letter itself only
        self.open = [max([m, *(self.most[c] for c in after.values())]) for m, after in zip(self.most, self.nodes)]
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.members: list[tuple] = []  # (node << 2 | edits), sorted
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.begun: list[tuple[int, str] | None] = []  # stems that end here
        self._state([0])  # state 0

    def _state(self, todo: list[int]) -> int:
        nodes, most, open_, least = self.nodes, self.most, self.open, {}
        while todo:  # letters of a term that the token leaves out
            pair = todo.pop()
            node, e = pair >> 2, pair & 3
            if e > most[node] or e >= least.get(node, 4):
                continue
            least[node] = e
            if e < open_[node]:
                todo += [child << 2 | e + 1 for child in nodes[node].values() if e < most[child]]
        key = tuple(sorted([node << 2 | e for node, e in least.items()]))
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.members)
            self.members.append(key)
            self.steps.append({})
            ends = [(e, end) for node, e in least.items() if self.ends[node] for end in self.ends[node] if e <= end[1]]
            self.accepts.append(min(((e, t) for e, (t, _, stem) in ends if not stem), default=None) if ends else None)
            self.begun.append(min(((e, t) for e, (t, _, stem) in ends if stem), default=None) if ends else None)
        return at

    def _step(self, state: int, ch: str) -> int:
        nodes, most, open_, reached = self.nodes, self.most, self.open, []
        for pair in self.members[state]:
            node, e = pair >> 2, pair & 3
            after = nodes[node]
            if (same := after.get(ch)) is not None:
                reached.append(same << 2 | e)
            if e < open_[node]:
                reached.append(node << 2 | e + 1)
                reached += [child << 2 | e + 1 for child in after.values() if e < most[child]]
        # fewest edits last: they are taken first, and the others of their nodes fall out
        reached.sort(key=lambda pair: -(pair & 3))
        after = self.steps[state][ch] = self._state(reached)
        return after

    def match(self, token: str) -> tuple[int, str] | None:
        state, begun = 0, None
        for ch in token:
            after = self.steps[state].get(ch)
            state = self._step(state, ch) if after is None else after
            if not self.members[state]:
                return begun
            found = self.begun[state]
            if found is not None and (begun is None or found < begun):
                begun = found
        accepted = self.accepts[state]
        return begun if accepted is None else accepted if begun is None else min(accepted, begun)


class Automaton:
    """Levenshtein automata of all terms at once, with up to ``edits(term)`` edits, on a trie of the terms and on one of
    the terms read backwards: of all edits of a match at most half lie in the one half of the term or in the other, so
    one of both directions finds it with half of the edits in the half it reads first.

    Stems are accepted as beginnings of a token, with up to ``stem_edits(stem)`` edits anywhere, forwards.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float] | None = None):
        some = [(t, edits(t)) for t in terms if edits(t)]
        begins = [(t, t, stem_edits(t), 0, True) for t in stems or () if stem_edits(t)]
        self.forwards = _Side([(t, t, k, len(t) // 2, False) for t, k in some] + begins)
        self.backwards = _Side([(t[::-1], t, k, len(t) - len(t) // 2, False) for t, k in some])

    def __len__(self) -> int:
        """States made so far."""
        return len(self.forwards.members) + len(self.backwards.members)

    def forget(self) -> None:
        self.forwards.forget()
        self.backwards.forget()

    def match(self, token: str) -> tuple[int, str] | None:
        """(edits, term) of the closest term, or stem that the token begins with, within its edits, or None."""
        one, other = self.forwards.match(token), self.backwards.match(token[::-1])
        return one if other is None else other if one is None else min(one, other)


def edits(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


def stem_edits(stem: str) -> int:
    return 0 if len(stem) < 6 else 1


class Lexicon:
    """What a token matches: None, or (kind, term, weight) with kind ``term``, ``stem`` or ``misspelt``; answers are remembered."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], known: set[str]):
        self.terms, self.stems, self.known = terms, stems, known
        self.automaton = Automaton(terms, stems)
        self.longest = 10**9 if any(map(stem_edits, stems)) else max(map(len, terms), default=0) + 2
        self.lengths = sorted({len(s) for s in stems})

        class Memory(dict):
            def __missing__(memory, token: str):
                memory[token] = found = self.look(token)
                return found

        self.memory = Memory()

    def look(self, token: str):
        if token in self.terms:
            return "term", token, self.terms[token]
        for n in self.lengths:
            if token[:n] in self.stems:
                return "stem", token[:n], self.stems[token[:n]]
        if 4 <= len(token) <= self.longest and token not in self.known and (found := self.automaton.match(token)):
            return "misspelt", found[1], max(self.terms.get(found[1], 0), self.stems.get(found[1], 0)) / (1 + 0.25 * found[0])
        return None

    def hits(self, text: str) -> tuple[list[tuple], int]:
        """[(start, end, kind, term, score)] and the number of tokens."""
        low = text.lower()
        tokens = WORD.findall(low)
        if len(self.memory) > 300_000:
            self.memory.clear()
        if len(self.automaton) > 150_000:
            self.automaton.forget()
        memory = self.memory
        found = [(i, m) for i, m in enumerate(map(memory.__getitem__, tokens)) if m is not None]
        if not found:
            return [], len(tokens)
        wanted, spans = {i for i, _ in found}, {}
        for i, m in enumerate(WORD.finditer(low)):
            if i in wanted:
                spans[i] = m.span()
        quotes = [m.span() for m in QUOTED.finditer(low)]
        opens = [a for a, _ in quotes]
        places = [i for i, _ in found]
        out = []
        for n, (i, (kind, term, weight)) in enumerate(found):
            a, b = spans[i]
            q = bisect_right(opens, a) - 1
            quoted = q >= 0 and quotes[q][0] < a and b <= quotes[q][1]
            close = bisect_right(places, i + WINDOW) - bisect_right(places, i - WINDOW - 1) - 1
            out.append((a, b, "quoted" if quoted else kind, term, weight * (1 + 0.25 * min(close, 4))))
        return out, len(tokens)


def features(hits: list[tuple], tokens: int) -> list[float]:
    sums = dict.fromkeys(("term", "stem", "misspelt", "quoted"), 0.0)
    for _, _, kind, _, score in hits:
        sums[kind] += score
    return [1.0, math.log1p(sums["term"] + sums["stem"] + sums["misspelt"]), math.log1p(sums["misspelt"]), math.log1p(sums["quoted"]), min(1.0, 20 * len(hits) / max(tokens, 20))]


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, strength: np.ndarray = STRENGTH) -> np.ndarray:
    """Logistic weights by damped Newton steps, drawn to the prior."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (strength * (w - prior) ** 2).sum())

    w, now = prior.copy(), loss(prior)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + strength * (w - prior)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(strength), slope)
        size = 1.0
        while (after := loss(w - size * move)) > now and size > 1e-6:
            size /= 2
        if now - after < 1e-9:
            break
        w, now = w - size * move, after
    return w


def in_training(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) != 1


def _ratio(tox: float, clean: float, all_tox: float, all_clean: float) -> tuple[float, float]:
    """(log odds, log-likelihood ratio) of a term in ``tox`` toxic and ``clean`` clean documents."""
    odds = math.log((tox + 0.5) / (all_tox + 1)) - math.log((clean + 0.5) / (all_clean + 1))
    share, n = all_tox / (all_tox + all_clean), tox + clean
    gain = sum(k * math.log(k / (n * s)) for k, s in ((tox, share), (clean, 1 - share)) if k)
    return odds, 2 * gain


def choose_terms(counts: list[tuple[str, bool, float, float]], all_tox: float, all_clean: float, tried: int) -> tuple[dict, dict]:
    """({term: weight}, {stem: weight}): those that are significant among ``tried`` candidates; a term below a chosen stem weighs what the stem does."""
    terms: dict[str, float] = {}
    stems: dict[str, float] = {}
    if not all_tox or not all_clean:
        return terms, stems
    bar = significance(tried)
    rated = [(t, stem, *_ratio(tox, clean, all_tox, all_clean)) for t, stem, tox, clean in counts]
    # words that fall short of that count too, by less, and a single one of them says little
    good = sorted(((t, stem, odds, gain) for t, stem, odds, gain in rated if odds > ODDS and gain > (bar if stem else WEAK * bar)), key=lambda r: (-r[3], r[0]))
    alone: dict[str, float] = {}  # the best word below each beginning
    for t, stem, _, gain in good:
        for n in () if stem else range(min(STEM_LENGTHS), len(t) + 1):
            alone[t[:n]] = max(gain, alone.get(t[:n], 0))
    for t, stem, odds, gain in good:
        above = next((t[:n] for n in STEM_LENGTHS if n < len(t) + (not stem) and t[:n] in stems), None)
        if above is not None:
            if not stem:
                terms[t] = stems[above]  # its misspellings are to be found
        elif not stem or alone.get(t, 0) < 0.8 * gain:  # else one word makes it up; the word itself is the term
            (stems if stem else terms)[t] = min(odds, 6.0) * min(1.0, gain / bar) ** 2
    return terms, stems


def significance(tried: int) -> float:
    """Of all candidates that could be significant, one at most is by chance."""
    return 2 * math.log(max(tried, 10))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, toxic, rep, text) -> (hash, toxic, rep, keys): the bands of min-hashes that near copies share."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            keys = [band_keys(shingles(t.as_py())) for t in part.column(3).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(keys, pa.list_(pa.int64()))], ["hash", "toxic", "rep", "keys"])


def copies(bands: pa.Table) -> pa.Table:
    """(hash, toxic, sig, rep): the group of a text and the id of the row that counts for the group's texts of that label."""
    bands = bands.sort_by([("hash", "ascending"), ("toxic", "ascending")]).combine_chunks()
    n, toxic, rep = bands.num_rows, bands.column("toxic").to_numpy(), bands.column("rep").to_numpy()
    keys = np.array([k.values.to_numpy() for k in bands.column("keys")], np.int64) if n else np.empty((0, 1), np.int64)
    sig = copy_groups(keys)
    _, first, of = np.unique(np.stack([sig, toxic.astype(np.int64)]), axis=1, return_index=True, return_inverse=True)
    return pa.table({"hash": bands.column("hash"), "toxic": bands.column("toxic"), "sig": pa.array(sig, pa.int64()), "rep": pa.array(rep[first][of.ravel()], pa.int64())})


def copy_groups(keys: np.ndarray) -> np.ndarray:
    """For each row of band keys the number of the first row that it shares a key with, or reaches over others."""
    n, bands = keys.shape
    root = np.arange(n)
    if not n:
        return root
    flat, row = keys.ravel(), np.repeat(np.arange(n), bands)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    sizes = np.diff(np.append(starts, len(flat)))
    while True:
        after = root.copy()
        np.minimum.at(after, row, np.repeat(np.minimum.reduceat(root[row], starts), sizes))
        after = after[after]
        if (after == root).all():
            return root
        root = after


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 20_000) -> dict:
    """The model: terms, stems, known words and weights.  Only rows for which :func:`in_training` holds are learnt from."""
    empty = {"terms": {}, "stems": {}, "known": [], "weights": PRIOR.tolist()}
    marked = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & in_training(F.col("id")))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    many = marked.count()
    if not many:
        return empty
    part = int(min(1.0, train_rows / many) * (1 << 20))
    bit = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20))
    sample = marked.where(bit < part)  # about train_rows at most: small enough to broadcast at any size of the corpus
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "id")
    texts = texts.withColumn("hash", F.xxhash64("text")).groupBy("id", "toxic").agg(F.min(F.struct("hash", "text")).alias("t"))
    words = F.array_remove(F.array_distinct(F.split(F.lower("t.text"), r"[^\p{L}\p{M}\p{N}_]+")), "")
    sample = materialise(texts.select("id", "toxic", "t.hash", "t.text", words.alias("words")), "toxicity-sample")
    # of the sample, which train_rows bounds, the driver gets the bands
    once = sample.groupBy("hash", "toxic").agg(F.min("id").alias("rep"), F.first("text").alias("text"))
    found = copies(once.mapInArrow(_bands, "hash long, toxic int, rep long, keys array<long>").toArrow())
    grouped = sample.join(F.broadcast(docs.sparkSession.createDataFrame(found)), ["hash", "toxic"])
    bags = grouped.withColumn("fold", F.pmod(F.xxhash64("sig", F.lit(5)), F.lit(FOLDS)))
    single = bags.where(F.col("id") == F.col("rep")).select("toxic", "fold", "words")
    totals = {(r.fold, r.toxic): r.n for r in single.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    tally = [F.sum(F.when((F.col("fold") == h) & (F.col("toxic") == t), 1).otherwise(0)).alias(f"n{h}{t}") for h in range(FOLDS) for t in (0, 1)]
    each = single.select("toxic", "fold", F.explode("words").alias("word")).where(F.length("word") >= 3)
    vocabulary = materialise(each.groupBy("word").agg(*tally), "toxicity-words")
    # a beginning counts once in a text, however many words begin so
    begin = lambda n: F.transform(F.filter("words", lambda w: F.length(w) > n), lambda w: F.left(w, F.lit(n)))
    starts = single.select("toxic", "fold", F.explode(F.array_distinct(F.concat(*[begin(n) for n in STEM_LENGTHS]))).alias("word"))
    stems = starts.groupBy("word").agg(*tally)
    toxic, clean = (sum((F.col(f"n{h}{t}") for h in range(1, FOLDS)), F.col(f"n0{t}")) for t in (1, 0))
    both = materialise(
        vocabulary.select("*", F.lit(False).alias("stem")).unionByName(stems.select("*", F.lit(True).alias("stem"))).where(toxic + clean >= 3), "toxicity-candidates"
    )
    tried = both.count()
    n = lambda h, t: totals.get((h, t), 0)
    # the driver gets what is significant in the sample or without one of its folds: as many as the labelled rows allow
    passed = F.lit(False)
    every = tuple(range(FOLDS))
    parts = [every, *(tuple(h for h in every if h != out) for out in every)]
    for some in parts:
        tox, cl = (F.expr("+".join(f"n{h}{t}" for h in some)).cast("double") for t in (1, 0))
        all_tox, all_clean = (float(sum(n(h, t) for h in some)) for t in (1, 0))
        share = all_tox / max(all_tox + all_clean, 1)
        if not 0 < share < 1:
            continue
        odds = F.log((tox + 0.5) / (all_tox + 1)) - F.log((cl + 0.5) / (all_clean + 1))
        part_of = lambda k, s: F.when(k > 0, k * F.log(k / ((tox + cl) * s))).otherwise(0.0)  # noqa: E731, B023
        passed |= (odds > ODDS) & (2 * (part_of(tox, share) + part_of(cl, 1 - share)) > WEAK * significance(tried) - 1e-6)
    candidates = both.where((toxic >= 3) & passed).orderBy("word", "stem").collect()

    def lexicon(folds: tuple[int, ...]) -> tuple[dict, dict]:
        rows = [(r.word, r.stem, sum(r[f"n{h}1"] for h in folds), sum(r[f"n{h}0"] for h in folds)) for r in candidates]
        return choose_terms(rows, sum(n(h, 1) for h in folds), sum(n(h, 0) for h in folds), tried)

    terms = [lexicon(some) for some in parts]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton(*t) for t in terms]
        for batch in batches:
            keep = [w for w in batch.column(0).to_pylist() if any(w not in t and a.match(w) for a, (t, _) in zip(automata, terms))]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], ["word"])

    # words near a term that toxic documents use at most three times as often as clean ones
    all_tox, all_clean = (max(1, sum(n(h, t) for h in every)) for t in (1, 0))
    usual = vocabulary.where(clean * (3 * all_tox) >= toxic * all_clean).select("word")
    known = [r.word for r in usual.mapInArrow(close, "word string").collect()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [Lexicon(*t, set(known)) for t in terms[1:]]
        for batch in batches:
            rows = [features(*sides[fold].hits(text)) for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    scored = bags.select("text", "fold", "toxic").mapInArrow(score, "toxic int, x array<double>").toArrow()
    y = np.minimum(scored.column(0).to_numpy(), 1).astype(float)
    x = np.array(scored.column(1).to_pylist(), float).reshape(-1, len(PRIOR))
    return {"terms": terms[0][0], "stems": terms[0][1], "known": known, "weights": fit(x, y).tolist()}


_ready: dict[str, tuple[Lexicon, np.ndarray]] = {}


def _scorer(model: dict) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights of a shipped model; a worker process keeps the last one, so its next tasks know the tokens met so far."""
    key = model["key"]
    if key not in _ready:
        _ready.clear()
        _ready[key] = Lexicon(model["terms"], model["stems"], set(model["known"])), np.array(model["weights"])
    return _ready[key]


HITS = "array<struct<start:int,end:int,kind:string,term:string,score:double>>"


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, hits): hits are the matches, with their places in the lower-cased text, kinds and scores."""
    shipped = docs.sparkSession.sparkContext.broadcast({**model, "key": uuid.uuid4().hex})  # terms of the bounded sample and the words close to them
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("term", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = _scorer(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [lexicon.hits(t) for t in part.column(1).to_pylist()]
                logits = np.array([features(*f) for f in found]) @ weights
                scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
                hits = [[dict(zip(("start", "end", "kind", "term", "score"), h)) for h in f[0]] for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(hits, kind)], ["id", "score", "hits"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"id long, score double, hits {HITS}")


def reject_toxic(docs: DataFrame, model: dict, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents whose score is below ``threshold``; columns as they are, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast({**model, "key": uuid.uuid4().hex})
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = _scorer(shipped.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                logits = np.array([features(*lexicon.hits(t or "")) for t in part.column(at).to_pylist()]) @ weights
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select(
        F.col("id").alias("doc_id"), F.coalesce(~in_training(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
