import datetime
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import folders
from quarry.sources.store import BucketedTable
from quarry.streaming import incremental


def files_of(root):
    return {os.path.relpath(os.path.join(at, n), root) for at, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_touch_their_buckets_and_families(spark, tmp_path):
    root = str(tmp_path / "t")
    store = BucketedTable(spark, root, ["id"], {"meta": ["status"], "vectors": ["vec", "text"]}, 8)
    base = spark.range(200).select("id", F.lit("old").alias("status"), F.array(F.col("id").cast("float")).alias("vec"), F.col("id").cast("string").alias("text"))
    assert store.upsert(base) == set(range(8))
    before = files_of(root)
    few = spark.createDataFrame([(3, "new"), (77, "new"), (5000, "new")], "id long, status string")
    touched = store.upsert(few)
    made = files_of(root) - before
    assert len(touched) <= 3 and all(f.startswith("meta/v=2") for f in made) and not before - files_of(root)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in made} <= touched
    assert {r.id for r in store.read(["meta"]).where("status = 'new'").collect()} == {3, 77}
    assert store.read().count() == 200 and BucketedTable.open(spark, root).read(version=1).where("status = 'new'").count() == 0
    store.delete(spark.createDataFrame([(3,), (4,)], "id long"))
    assert store.read().count() == 198 and store.read(["vectors"]).count() == 198
    with pytest.raises(ValueError, match="no id"):
        store.upsert(spark.createDataFrame([(None, "x")], "id long, status string"))
    assert store.vacuum(1) > 0 and store.read().count() == 198


def test_a_batch_counts_once_and_an_unfinished_write_not_at_all(spark, tmp_path):
    root = str(tmp_path / "t")
    store = BucketedTable(spark, root, ["k"], {"n": ["n"]}, 2)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    one = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n long")
    store.upsert(one, 0, add)
    store.upsert(one, 0, add)
    assert rows_of(store.read()) == [("a", 4), ("b", 2)]
    one.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{root}/n/v=2")  # stopped before its manifest
    store.upsert(one, 1, add)
    assert rows_of(store.read()) == [("a", 8), ("b", 4)]
    assert rows_of(BucketedTable.open(spark, root).read(version=1)) == [("a", 4), ("b", 2)]


def test_late_rows_count(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    at = datetime.datetime(2024, 5, 1, 12)
    for n, day in enumerate([0, 300, 1, -400]):
        spark.createDataFrame([(at + datetime.timedelta(days=day), "a", 2.0)], "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(str(source))
        out = incremental.windowed_totals(spark, str(source), root, "1 day")
        assert out.count() == n + 1 and out.agg(F.sum("n")).first()[0] == n + 1


def law(path, text, name, year, law_id="x"):
    return (path, text, law_id, name, datetime.date(year, 1, 1))


def listed(spark, rows):
    df = spark.createDataFrame(rows, "path string, text string, law_id string, law_name string, start date")
    df = df.withColumns({"kind": F.lit("law"), "language": F.lit("he")})
    return df.withColumns({"sha": F.sha2("text", 256), "meta_sha": F.sha2(F.to_json(F.struct("law_id", "law_name", "start")), 256)})


def test_folder_runs(spark, tmp_path):
    index = folders.FolderIndex(spark, str(tmp_path / "i"), 2)

    def run(rows, **kw):
        out = index.run(listed(spark, rows), **kw)
        return {r.path: r.action for r in out.collect()}, {(r.law_id, r.start.year, r.status, r.text) for r in index.chunks.read().collect()}

    a, b = law("a", "text a", "law", 2000), law("b", "text b", "law", 2010)
    assert run([a, b]) == ({"a": "indexed", "b": "indexed"}, {("x", 2000, "amended", "text a"), ("x", 2010, "current", "text b")})
    assert run([a, b])[0] == {"a": "unchanged", "b": "unchanged"}
    twin = law("c", "text c", "law", 2000)  # same law and start as a: the last path's text counts
    out = index.run(listed(spark, [a, b, twin])).collect()
    assert {r.path: bool(r.warning) for r in out} == {"a": False, "b": False, "c": True}
    assert {r.text for r in index.chunks.read().collect()} == {"text c", "text b"}
    moved = law("c", "text c", "law", 2020)  # leaves the version: a's text is laid again
    assert run([a, b, moved])[1] == {("x", 2000, "amended", "text a"), ("x", 2010, "amended", "text b"), ("x", 2020, "current", "text c")}
    assert run([("d", *a[1:]), b]) == ({"d": "renamed", "b": "unchanged", "c": "missing"}, {("x", 2000, "amended", "text a"), ("x", 2010, "amended", "text b"), ("x", 2020, "current", "text c")})
    assert run([("d", *a[1:]), b], prune=True) == ({"d": "unchanged", "b": "unchanged", "c": "retracted"}, {("x", 2000, "amended", "text a"), ("x", 2010, "current", "text b")})
    assert {r.path for r in index.state.read().collect()} == {"b", "d"}


def test_files_of_a_folder(spark, tmp_path):
    for name in ("a.txt", "sub/b.txt", "laws/c.txt", "a.txt.meta.json", "~x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("Law of things, 1999\nbody")
    got = folders.source_files(spark, f"file:{tmp_path}", [".txt"], ["laws"])
    assert sorted(os.path.basename(r.path) for r in got.collect()) == ["a.txt", "b.txt"]
    d = folders.described(got.select("path", "modified", F.col("content").cast("string").alias("text"))).first()
    assert d.law_name == "Law of things, 1999" and d.start == datetime.date(1999, 1, 1) and len(d.sha) == len(d.meta_sha) == 64


def test_uploads_and_review(spark, tmp_path):
    staged = BucketedTable(spark, str(tmp_path / "s"), ["path", "sha"], folders.STAGED, 2)
    up = lambda *rows: spark.createDataFrame(rows, "path string, sha string")
    assert folders.scan_uploads(up(("p", "1"), ("q", "2")), staged).count() == 2
    folders.scan_uploads(up(("p", "3"), ("q", "2")), staged)
    status = lambda: {(r.path, r.sha): r.status for r in staged.read().collect()}
    assert status() == {("p", "1"): "rejected", ("p", "3"): "pending", ("q", "2"): "pending"}
    said = spark.createDataFrame([("p", "3", "approved", "me", ""), ("p", "1", "approved", "me", ""), ("z", "9", "approved", "me", "")], "path string, sha string, status string, reviewer string, reason string")
    assert {r.path + r.sha for r in folders.review(staged, said).collect()} == {"p1", "z9"}
    assert status() == {("p", "1"): "rejected", ("p", "3"): "approved", ("q", "2"): "pending"}


def test_rows_leave_with_a_change(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), ["k"], {"a": ["x"], "b": ["y"]}, 2)
    rows = lambda *r: spark.createDataFrame(r, "k long, x long, y long")
    t.upsert(rows(*[(i, i, i) for i in range(8)]))
    t.upsert(rows((7, 70, 70), (9, 90, 90)), leaving=rows((0, 0, 0), (7, 0, 0), (99, 0, 0)))
    assert {tuple(r) for r in t.read().collect()} == {(i, i, i) for i in range(1, 7)} | {(7, 70, 70), (9, 90, 90)}
    assert t.manifest()["version"] == 2  # each bucket was written once


def test_pieces_need_no_shuffle(spark):
    texts = ["a" * 999 + "\nb\n\nc", "x" * 2500 + "\ny", "\n" * 1500 + "z", "  \n ", "", None, "\n".join(str(i) for i in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = folders.pieces(rows)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = set()
    for i, text in enumerate(texts):
        start, parts = 0, {}
        for line in [] if text is None else text.split("\n"):
            parts.setdefault(start // 1000, []).append(line)
            start += len(line) + 1
        want |= {(i, n, "\n".join(p)) for n, p in parts.items() if "\n".join(p).strip(" ")}
    assert {tuple(r) for r in got.collect()} == want


def test_folder_texts_are_asked_for_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        asked.add(1)
        return text

    df = listed(spark, [law(str(i), f"text {i}", "law", 2000 + i) for i in range(5)]).withColumn("text", seen.asNondeterministic()("text"))
    index = folders.FolderIndex(spark, str(tmp_path / "i"), 2)
    assert index.run(df).count() == 5 and asked.value == 5
    assert {r.text for r in index.chunks.read().collect()} == {f"text {i}" for i in range(5)}
