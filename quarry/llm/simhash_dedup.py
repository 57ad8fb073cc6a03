"""SimHash near-duplicate groups through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ in at most ``radius`` bits
differ in at most ``radius`` bytes, so they share at least ``8 - radius`` positional bytes.  The index
therefore has one posting list for each choice of that many positions and their values: a pair meets in a
list exactly when its tally of shared positional bytes reaches the guaranteed minimum, and no pair below
the minimum is ever formed.  Pairs that meet are verified by their Hamming distance.

Within a posting list only the edges of a spanning forest are emitted, so a large group of near copies
costs edges in proportion to its size.  Lists longer than ``max_list`` are not compared pair by pair:
their fingerprints are linked through every value within ``radius / 2`` flipped bits (two fingerprints are
within ``radius`` bits exactly when they share such a value), which is linear in the list and loses no link.

Defined results: a null or blank text has fingerprint zero and is linked like any other; repeated rows keep
one output row each; a null id keeps its row and takes the smallest id of its group (null if there is none);
``keep_one`` lets it stay only in a group without ids;
an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_scratch, free_names, id_and_text, materialise

#: Shingles whose bits are summed at once; bounds the memory of a very long text.
CHUNK = 65_536


def fingerprint_bytes(raw: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of one UTF-8 text."""
    import xxhash

    words = raw.lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    return fingerprint_of(np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), np.uint64, len(first)))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned fingerprint of the shingles' hashes, repeats included: a bit is set if it is in more than half of them."""
    sums = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """Rows (id, hash, fp): a hash of the text, and the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            values = [fingerprint_bytes(t.as_py(), shingle, seed) for t in texts]
            fps = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], ["id", "hash", "fp"])

    rows = id_and_text(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "id long, hash long, fp long")


def posting_keys(fps: np.ndarray, least: int) -> np.ndarray:
    """For each fingerprint a row of keys, one for each choice of ``least`` of its positional bytes."""
    eight = fps.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.uint64)
    choices = list(combinations(range(8), least))
    keys = np.empty((len(fps), len(choices)), np.uint64)
    for at, choice in enumerate(choices):
        key = np.full(len(fps), at, np.uint64)
        for position in choice:
            key = (key << np.uint64(8)) | eight[:, position]
        keys[:, at] = key
    return keys.view(np.int64)


def _forest(fps: np.ndarray, radius: int, least: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links within one posting list."""
    left = fps.copy()
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            a = frontier.pop()
            differing = a ^ left
            shared = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            linked = (shared >= least) & (np.bitwise_count(differing.view(np.uint64)) <= radius)
            if linked.any():
                found = left[linked]
                left = left[~linked]
                frontier.extend(found)
                for b in found:
                    yield int(a), int(b)


def _link(radius: int, least: int, max_list: int):
    """Over postings sorted by key: edges (a, b); (a, null) marks a fingerprint of a list that is too long."""

    def rows(a: list[int], b: list[int | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, hot = np.empty(0, np.int64), np.empty(0, np.int64), None
        last = False
        source = iter(batches)
        while not last:
            batch = next(source, None)
            last = batch is None
            if batch is not None:
                keys = np.concatenate((keys, batch.column(0).to_numpy()))
                fps = np.concatenate((fps, batch.column(1).to_numpy()))
            if not len(keys):
                continue
            a: list[int] = []
            b: list[int | None] = []
            bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            runs = list(zip(bounds[:-1], bounds[1:]))
            whole = runs if last else runs[:-1]
            sizes = np.diff(bounds)
            for i in np.flatnonzero(sizes[: len(whole)] > 1) if hot is None else range(len(whole)):
                lo, hi = whole[i]
                if hi - lo > max_list or keys[lo] == hot:
                    a += fps[lo:hi].tolist()
                    b += [None] * int(hi - lo)
                elif hi - lo > 1:
                    for x, y in _forest(fps[lo:hi], radius, least):
                        a.append(x)
                        b.append(y)
            before, hot = hot, None
            if not last:
                lo, hi = runs[-1]
                if hi - lo > max_list or keys[lo] == before:  # the list goes on: what is here is marked, one row kept
                    hot = keys[lo]
                    a += fps[lo:hi].tolist()
                    b += [None] * int(hi - lo)
                    lo = hi - 1
                keys, fps = keys[lo:].copy(), fps[lo:].copy()
            if a:
                yield rows(a, b)

    return run


def _variants(radius: int):
    """Every value within radius / 2 flipped bits of a fingerprint."""
    masks = [0]
    for k in range(1, radius // 2 + 1):
        masks += [sum(1 << bit for bit in bits) for bits in combinations(range(64), k)]
    flips = np.array(masks, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 256):
                part = fps[at : at + 256]
                near = (part[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(part, len(flips)))], ["near", "fp"])

    return run


def fingerprint_links(distinct_fps: DataFrame, radius: int = 4, max_list: int = 4096) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) whose components are those of all links within radius."""
    if radius % 2 or not 0 <= radius <= 6:
        raise ValueError("radius must be 0, 2, 4 or 6")
    least = 8 - radius

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 1024):
                part = fps[at : at + 1024]
                keys = posting_keys(part, least)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part, keys.shape[1]))], ["key", "fp"])

    postings = distinct_fps.select("fp").mapInArrow(post, "key long, fp long")
    found = materialise(
        postings.repartition("key").sortWithinPartitions("key").mapInArrow(_link(radius, least, max_list), "a long, b long"), "simhash-links"
    )
    near = found.where("b is not null")
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return near
    stars = hot.mapInArrow(_variants(radius), "near long, fp long")
    hubs = stars.groupBy("near").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    more = stars.join(hubs, "near").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return near.unionByName(more)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps: rows (v, root), one for each vertex but the roots.

    ``root`` is the smallest vertex of the component.  Neighbourhoods are only aggregated and joined, never gathered.
    """
    now = materialise(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).where("v <> root").distinct(), "components"
    )
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            return now
        seen = (state["n"], state["h"])
        both = now.unionByName(now.select(F.col("root").alias("v"), F.col("v").alias("root")))
        least = both.groupBy("v").agg(F.min("root").alias("low"))
        least = least.select(F.col("v").alias("u"), F.least("v", "low").alias("low"))
        large = (
            both.where("root > v").join(least, F.col("v") == F.col("u")).select(F.col("root").alias("v"), F.col("low").alias("root"))
        ).where("v <> root").distinct()
        low = large.groupBy("v").agg(F.min("root").alias("low")).select(F.col("v").alias("u"), "low")
        small = large.join(low, F.col("v") == F.col("u")).select(F.explode(F.array(F.struct("root", "low"), F.struct(F.col("v").alias("root"), "low"))).alias("x"))
        after = materialise(
            small.select(F.greatest("x.root", "x.low").alias("v"), F.least("x.root", "x.low").alias("root")).where("v <> root").distinct(),
            "components",
        )
        drop_scratch(now)
        now = after


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, radius: int = 4, max_list: int = 4096
) -> DataFrame:
    """One row per document: (id, hash, fp, component, keep).

    ``component`` is the smallest id of all documents it is linked to; ``hash`` is the text's.  ``keep`` marks the one
    document of each group that stays, that of the smallest id (rows without an id last, then by hash).
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash"))
    reps = materialise(rows.groupBy("fp").agg(first.alias("rep")), "simhash-reps")
    roots = components(fingerprint_links(reps, radius, max_list))
    rooted = reps.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("kept"))
    classes = rooted.join(smallest, "root").select("fp", "kept")
    return rows.join(classes, "fp").select(
        "id", "hash", "fp", F.col("kept.id").alias("component"), (F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("hash") == F.col("kept.hash"))).alias("keep")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, groups=near_duplicates, **options) -> DataFrame:
    """The documents with one of each near-duplicate group, columns as they are; equal rows of it once.

    ``groups`` finds the groups: :func:`near_duplicates`, or another that gives id, hash and keep.
    The list of those that go is broadcast up to ``broadcast_rows`` rows and joined by a shuffle beyond.
    """
    found = materialise(groups(docs, id_col, text_col, **options), "simhash-groups")
    gone_id, gone_hash = free_names(docs, "__id", "__hash")
    gone = found.where(~F.col("keep")).select(F.col("id").alias(gone_id), F.col("hash").alias(gone_hash)).distinct()
    again = found.where("keep").groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias(gone_id), F.col("hash").alias(gone_hash))
    own_id, own_hash = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    same = own_id.eqNullSafe(F.col(gone_id)) & (own_hash == F.col(gone_hash))
    small = gone.count() <= broadcast_rows
    left = docs.join(F.broadcast(gone) if small else gone, same, "left_anti")
    if again.isEmpty():
        return left
    repeated = left.join(again, same, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(again, same, "left_anti").unionByName(repeated)


def op4_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
