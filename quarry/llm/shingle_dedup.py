"""Near-duplicate groups by SimHash candidates and the exact Jaccard similarity of word shingles, for the pipeline.

Two texts are linked when the sets of their ``shingle``-word shingles have a similarity of ``least`` or more; groups are
the components of the links.  Candidates are the links of ``simhash_dedup``'s index (positional bytes, count filtering) over
fingerprints of the same shingles, within ``radius`` bits.  All that meet are compared with their whole sets, so nothing below
``least`` is linked, and the components of what holds are the first groups.

A pair at ``least`` may lie beyond any radius that the index can guarantee, so a second search goes on from these groups:
``BANDS`` keys of ``ROWS`` min-hashes each, of which a pair at 0.8 shares none with a probability of 5e-8 (less above).  It
compares sets of different groups only.

Texts of one set are compared once.  In lists of at most ``max_list`` sets all pairs are candidates.  Longer lists first
compare all sets with ``hubs`` of them, others in each list, which joins nearly all of a large group.  Where a list is still
of several groups, the sets outside its largest group are compared with those of all such lists by a prefix filter:
sets of a similarity of ``least`` share one of their 1 - ``least`` rarest shingles, whichever order of rarity is taken, and
the first that they share leaves enough behind it in both.
The order is by counts of the shingles' upper bits, so a bounded table; edited copies have rare shingles of their own and
meet few.  No list is gathered, and no step makes all pairs of a long one.

Defined results: those of ``simhash_dedup``; blank and null texts are one group; a text of fewer words is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash_dedup
from ._common import id_and_text, materialise
from .simhash_dedup import components

ROWS, BANDS = 4, 32
_odd = np.random.default_rng(42).integers(0, 2**64, ROWS * BANDS, np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 8192


def shingle_hashes(raw: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the shingles of one UTF-8 text in their order, repeats included."""
    import xxhash

    words = raw.lower().split()  # bytes: only A-Z, only ASCII white space
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), np.uint64, len(first))


def shingles(raw: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one UTF-8 text."""
    return np.unique(shingle_hashes(raw, shingle, seed))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band: its min-hashes mixed with its number."""
    low = np.full(ROWS * BANDS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), CHUNK):
        low = np.minimum(low, (hashes[None, at : at + CHUNK] * _odd[:, None]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for row in low.reshape(ROWS, BANDS):
        key = (key ^ row) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _rows(shingle: int, seed: int):
    """(id, text, hash) -> (id, hash, v, fp, keys): v is a hash of the set of shingles, fp its text's fingerprint."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets, fps = [], []
                for t in part.column(1).cast(pa.large_binary()):
                    hashes = shingle_hashes(t.as_py(), shingle, seed)
                    fps.append(simhash_dedup.fingerprint_of(hashes))
                    sets.append(np.unique(hashes))
                v = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)
                keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
                fp = pa.array(np.array(fps, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(v), fp, keys], ["id", "hash", "v", "fp", "keys"])

    return run


def _fingerprint_pairs(reps: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of sets: those of one fingerprint with one of them, and one of each of two fingerprints that the index links."""
    firsts = materialise(reps.groupBy("fp").agg(F.min("v").alias("first")), "shingle-fingerprints")
    links = simhash_dedup.fingerprint_links(firsts, radius)
    ends = links.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("one")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("two")), "b")
    same = reps.join(firsts, "fp").where("v <> first").select(F.col("first").alias("one"), F.col("v").alias("two"))
    pairs = ends.select("one", "two").unionByName(same)
    return materialise(pairs.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct(), "shingle-near")


def _lists(reps: DataFrame) -> DataFrame:
    """(key, v, n): the sets that share a key with others."""
    postings = reps.select(F.explode("keys").alias("key"), "v")
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return materialise(postings.join(lists, "key"), "shingle-met")


def _candidates(met: DataFrame, roots: DataFrame, max_list: int, hubs: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different groups that share a key, for long lists only those with a hub; and the members (key, v) of long lists."""
    met = met.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    groups = met.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    met = materialise(met.join(groups, "key"), "shingle-apart-lists")
    few = met.where(F.col("n") <= max_list).groupBy("key").agg(F.collect_list(F.struct("v", "root")).alias("vs"))
    few = few.select(F.explode("vs").alias("x"), "vs").select("x", F.explode("vs").alias("y")).where("x.v < y.v AND x.root <> y.root")
    few = few.select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    long = met.where(F.col("n") > max_list)
    # the first hub is the set in the most company, which is what the copies are copies of; others are any
    company = long.groupBy("v").agg(F.sum("n").alias("company"))
    own = F.struct("v", "root")
    hub = [F.max_by(own, F.struct("company", "v"))] + [F.min_by(own, F.struct(F.xxhash64("v", "key", F.lit(i)).alias("h"), "v")) for i in range(1, hubs)]
    chosen = long.join(company, "v").groupBy("key").agg(F.array(*hub).alias("hubs"))
    far = long.join(chosen, "key").select("v", "root", F.explode("hubs").alias("hub")).where("root <> hub.root")
    far = far.select(F.least("v", "hub.v").alias("a"), F.greatest("v", "hub.v").alias("b"))
    return materialise(few.unionByName(far).distinct(), "shingle-pairs"), long.select("key", "v")


def _sets(wanted: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, seed: int, broadcast_rows: int) -> DataFrame:
    """(v, s): the shingles of each text set wanted."""
    wanted = wanted.distinct().join(reps, "v").select("v", F.col("rep.hash").alias("hash"))
    wanted = materialise(wanted, "shingle-wanted")
    small = wanted.count() <= broadcast_rows
    found = texts.join(F.broadcast(wanted) if small else wanted, "hash").select("v", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingles(t.as_py(), shingle, seed).view(np.int64) for t in part.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["v", "s"])

    return materialise(found.mapInArrow(run, "v long, s array<long>").groupBy("v").agg(F.first("s").alias("s")), "shingle-sets")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of ``least`` or more."""
    one = sets.select(F.col("v").alias("a"), F.col("s").alias("sa"))
    two = sets.select(F.col("v").alias("b"), F.col("s").alias("sb"))
    # sizes alone rule out some
    near = F.least(F.size("sa"), F.size("sb")) >= F.lit(least) * F.greatest(F.size("sa"), F.size("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return materialise(
        pairs.join(one, "a").join(two, "b").where(near).where(both >= F.lit(least) * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "shingle-links"
    )


def prefix_length(n: int, least: float) -> int:
    """How many shingles of a set of n to look at: sets at ``least`` or more share one of so many first ones."""
    return n - int(np.ceil(least * n - 1e-9)) + 1


def _prefixes(sets: DataFrame, least: float, bits: int = 18) -> DataFrame:
    """(v, n, at, token): the rarest shingles of each set and their places, by counts of their upper ``bits``, then by themselves.

    At most 2^bits counts come to the driver and go to the tasks."""
    counted = sets.select(F.explode("s").alias("s")).select(F.shiftrightunsigned("s", 64 - bits).cast("int").alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(1 << bits, np.int64)
    counts[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vs, ns, places, tokens = [], [], [], []
                for v, s in zip(part.column(0).to_pylist(), part.column(1)):
                    own = s.values.to_numpy()
                    many = prefix_length(len(own), least)
                    order = np.lexsort((own, often[(own.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)]))[:many]
                    tokens.append(own[order])
                    vs.append(np.full(many, v))
                    ns.append(np.full(many, len(own)))
                    places.append(np.arange(many))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (vs, ns, places, tokens)], ["v", "n", "at", "token"])

    return sets.mapInArrow(run, "v long, n long, at long, token long")


def _apart(long: DataFrame, roots: DataFrame, sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame | None:
    """Pairs (a, b) of different groups that share a long list and a rare shingle, without those compared before."""
    members = materialise(long.join(roots, "v", "left").select("key", "v", F.coalesce("root", "v").alias("root")), "shingle-members")
    groups = members.groupBy("key", "root").agg(F.count("*").alias("many"))
    lists = groups.groupBy("key").agg(F.count("*").alias("groups"), F.max(F.struct("many", "root"))["root"].alias("largest")).where("groups > 1")
    split = materialise(members.join(lists.select("key", "largest"), "key"), "shingle-split")
    if split.isEmpty():
        return None
    within = split.select("v", "root").distinct()
    outside = split.where("root <> largest").select("v").distinct()
    near = materialise(_prefixes(sets.join(within, "v", "left_semi"), least).join(within, "v"), "shingle-prefixes")
    few = near.join(outside, "v", "left_semi").select("token", F.col("v").alias("w"), F.col("n").alias("m"), F.col("at").alias("its_at"), F.col("root").alias("its"))
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("n") + F.col("m")) - 1e-9)
    alike = (F.col("root") != F.col("its")) & (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("its_at")) >= need)
    met = near.join(few, "token").where(alike).select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()
    return materialise(met.join(pairs, ["a", "b"], "left_anti"), "shingle-apart")


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    least: float = 0.8,
    seed: int = 42,
    max_list: int = 8,
    hubs: int = 2,
    radius: int = 4,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """One row per document: (id, hash, component, keep), as ``simhash_dedup.near_duplicates`` gives them."""
    texts = id_and_text(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    rows = materialise(texts.mapInArrow(_rows(shingle, seed), "id long, hash long, v long, fp long, keys array<long>"), "shingle-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash"))
    reps = materialise(rows.groupBy("v").agg(first.alias("rep"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "shingle-reps")
    near, met = _fingerprint_pairs(reps, radius), _lists(reps)
    wanted = near.select(F.explode(F.array("a", "b")).alias("v")).unionByName(met.select("v"))
    sets = _sets(wanted, reps, texts, shingle, seed, broadcast_rows)
    groups = components(_similar(near, sets, least))
    pairs, long = _candidates(met, groups, max_list, hubs)
    links = groups.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(_similar(pairs, sets, least))
    roots = components(links)
    apart = _apart(long, roots, sets, pairs, least)
    if apart is not None and not apart.isEmpty():
        roots = components(links.unionByName(_similar(apart, sets, least)))
    rooted = reps.join(roots, "v", "left").select("v", "rep", F.coalesce("root", "v").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("kept"))
    classes = rooted.join(smallest, "root").select("v", "kept")
    return rows.join(classes, "v").select(
        "id", "hash", F.col("kept.id").alias("component"), (F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("hash") == F.col("kept.hash"))).alias("keep")
    )
