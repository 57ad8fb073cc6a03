import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.packing import encoding, fullest, minimum_bin_slack, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
FAST = encoding(open(PATH, encoding="utf-8").read())


@settings(max_examples=200, deadline=None)
@given(st.text() | st.text(alphabet=" \n\t'sdlABé1²漢 　<|endoftext>"))
def test_ids_are_those_of_the_tokenizers_file(text):
    assert list(FAST.encode_to_numpy(text, allowed_special=FAST.special_tokens_set)) == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(0, 40))
def test_fullest_is_the_best_subset(lengths, room):
    counts = np.bincount(lengths, minlength=41)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums}
    chosen = fullest(counts, room)
    assert sum(n * k for n, k in chosen) == max(s for s in sums if s <= room)
    assert all(0 < k <= counts[n] for n, k in chosen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_patterns_use_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=51)
    used = np.zeros(51, int)
    for times, pattern in minimum_bin_slack(counts, 50):
        assert times > 0 and sum(n * k for n, k in pattern) <= 50
        for n, k in pattern:
            used[n] += times * k
    assert (used == counts).all()


def test_packing_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 9000), (-3, "word " * 9000), (None, "x")], "doc_id long, text string")
    docs = docs.unionByName(extra).withColumn("length", F.lit("clash")).cache()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append([*PLAIN.encode(r.text or "", add_special_tokens=False).ids, 0])
    for limit in (2_000_000, 0):
        got = pack(docs, PATH, broadcast_rows=limit).collect()
        parts, bins = defaultdict(list), defaultdict(list)
        for r in got:
            parts[r.id].append((r.start, r.piece, r.length, r.ids))
            bins[r.sequence_id].append((r.offset, r.length))
        assert parts.keys() == texts.keys()
        for i, found in parts.items():
            copies = len(texts[i])
            found = sorted(found)[::copies]
            ids = texts[i][0]
            assert [p[1] for p in found] == list(range(len(found)))
            assert [list(np.frombuffer(p[3], "<u4")) for p in found] == [ids[p[0] : p[0] + p[2]] for p in found]
            assert sum(p[2] for p in found) == len(ids) and all(p[2] == 2048 for p in found[1:])
            assert zlib.crc32(found[0][3]) >= 0
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(len(x) for v in texts.values() for x in v)
        assert len(bins) <= -(-total // 2048) * 1.03 + 2
    assert pack(docs.limit(0), PATH).count() == 0
