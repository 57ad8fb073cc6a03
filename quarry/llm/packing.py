"""Best-fit packing of tokenised documents into sequences of at most ``capacity`` tokens by minimum bin slack.

Texts are tokenised once, cut into pieces and written with their place in their partition.  Packing needs no
rows: the counts of pieces by length (at most ``capacity`` numbers, whatever the size of the corpus) go to the
driver.  For each bin the longest piece left is taken, and a bitset subset-sum over the lengths that are left
finds the fullest feasible combination to go with it; the combination is removed as often as the counts allow.
The resulting patterns are then dealt to the pieces by their rank within their length, without a shuffle: the
rank is the piece's place in its partition plus the pieces of that length in earlier partitions.

Token ids are those of the ``tokenizers`` file given; they are computed with ``tiktoken`` from the same
vocabulary, which gives the same ids five times as fast (see the tests), special tokens included.

Defined results: a null or empty text is one piece, the end id alone; repeated rows are packed each; a null id
is kept; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import id_and_text, materialise

#: Fixed value: how this family of byte-level vocabularies splits a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

PIECES = "pid int, id long, piece int, start long, length int, nth long, ids binary"
#: Characters of text tokenised at once.
BATCH_CHARS = 4_000_000


def byte_level_ranks(tokenizer_json: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(token bytes -> id, special token -> id) of a byte-level BPE file."""
    spec = json.loads(tokenizer_json)
    if spec["model"]["type"] != "BPE":
        raise ValueError("a byte-level BPE file is needed")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    # byte-level files write each byte as one printable character: printable bytes as they are, others from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return ranks, special


def encoding(tokenizer_json: str):
    import tiktoken

    ranks, special = byte_level_ranks(tokenizer_json)
    return tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written pieces (pid, id, piece, start, length, nth, ids): nth counts pieces of the length in the partition.

    A document of more than ``capacity`` ids is cut into pieces of ``capacity``; its first piece takes what is over.
    ``ids`` holds little-endian unsigned 32-bit ids.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoding(shipped.value)
        special, pid = encode.special_tokens_set, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            group = (sizes // BATCH_CHARS).astype(np.int64)
            edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            for lo, hi in zip(edges[:-1], edges[1:]):
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                for i, text in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist()):
                    ids = np.append(encode.encode_to_numpy(text, allowed_special=special), np.uint32(end_id)).astype("<u4")
                    first = len(ids) % capacity or min(capacity, len(ids))
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        for column, value in zip(rows, (i, k, a, b - a, seen[b - a], ids[a:b].tobytes())):
                            column.append(value)
                        seen[b - a] += 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(rows, types)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), pid, np.int32)), *arrays], ["pid", "id", "piece", "start", "length", "nth", "ids"])

    return materialise(id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES), "packing-pieces")


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """[(length, copies)]: the combination of what is left that fills ``room`` best; bitset subset-sum, longest lengths first."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[1 : room + 1])[::-1] + 1:
        length = int(length)
        most = min(int(counts[length]), room // length)
        before, left, k = reach, most, 1
        while left:  # copies in powers of two
            take = min(k, left)
            reach |= (reach << (take * length)) & full
            left -= take
            k *= 2
        steps.append((length, most, before))
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen = []
    for length, most, before in reversed(steps):
        copies = next(j for j in range(most + 1) if at >= j * length and before >> (at - j * length) & 1)
        if copies:
            chosen.append((length, copies))
            at -= copies * length
    return chosen


def minimum_bin_slack(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, copies)])]: patterns that use up ``counts`` (pieces by length)."""
    left, patterns = counts.astype(np.int64).copy(), []
    longest = capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return patterns
        left[longest] -= 1
        pattern = dict(fullest(left, capacity - longest))
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(int(left[length]) // copies for length, copies in pattern.items())
        for length, copies in pattern.items():
            left[length] -= times * copies
        patterns.append((times, sorted(pattern.items(), reverse=True)))


def _lookup(patterns) -> tuple[np.ndarray, ...]:
    """Arrays by which a piece's length and rank give its bin and offset, sorted by length and first rank."""
    rows, bins, used = [], 0, {}
    for times, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            first = used.get(length, 0)
            rows.append((length << 40 | first, first, bins, copies, offset))
            used[length] = first + times * copies
            offset += length * copies
        bins += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table[:, i].copy() for i in range(5))


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 2_000_000
) -> DataFrame:
    """Rows (id, piece, start, length, ids, sequence_id, offset), one for each piece.

    The counts of earlier partitions by length are broadcast up to ``broadcast_rows`` of them, and joined beyond.
    """
    pieces = tokenised_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    spark = docs.sparkSession
    counts = materialise(pieces.groupBy("pid", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    lookup = spark.sparkContext.broadcast(_lookup(minimum_bin_slack(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("pid", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    many = counts.count()
    if many <= broadcast_rows:
        based = pieces.join(F.broadcast(bases), ["pid", "length"])
    else:
        based = pieces.join(bases, ["pid", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, bins, copies, offsets = lookup.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy().astype(np.int64), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 40) | rank, "right") - 1
            place = rank - firsts[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(bins[at] + place // copies[at]), pa.array(offsets[at] + place % copies[at] * length)],
                ["id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    rows = based.select("id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", (F.col("base") + F.col("nth")).alias("rank"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "sequence_id", "offset"
    )
