"""A keyed table in buckets and column families, of which a change rewrites only what it touches.

Each family of columns is stored by itself in buckets of the key's hash: ``root/family/v=N/bucket=K``.  A manifest, one small
file a version, says which version of each bucket counts; writing it commits.  A run that stops before leaves files that no
manifest names, and the next run writes the same version again.  A change reads and writes the buckets of its keys in the
families of its columns, so new descriptions leave texts and vectors as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class BucketedTable:
    """``families`` names the columns of each family beside the key.  Key columns must not be null: such rows are refused.

    The number of buckets bounds what the driver holds (the manifest) and how much a small change rewrites; choose it so that
    a bucket of a family is some hundred megabytes.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], families: dict[str, list[str]], buckets: int = 64):
        if "bucket" in {*key, *(c for cs in families.values() for c in cs)}:
            raise ValueError("no column may be named bucket")
        self.spark, self.root, self.key, self.families, self.buckets = spark, root.rstrip("/"), key, families, buckets

    # what is stored -------------------------------------------------------------------------------------------------

    @staticmethod
    def _versions(spark: SparkSession, root: str) -> list[int]:
        fs, p = _path(spark, f"{root}/_manifests")
        if not fs.exists(p):
            return []
        found = [(re.fullmatch(r"v(\d+)", s.getPath().getName()), s.getPath()) for s in fs.listStatus(p)]
        return sorted(int(m[1]) for m, at in found if m and fs.exists(_path(spark, f"{at.toString()}/_SUCCESS")[1]))

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> BucketedTable:
        """The table as its last manifest describes it."""
        versions = cls._versions(spark, root.rstrip("/"))
        if not versions:
            raise ValueError("no version has been written")
        m = json.loads(spark.read.text(f"{root.rstrip('/')}/_manifests/v{versions[-1]}").first()[0])
        return cls(spark, root, m["key"], m["families"], m["buckets"])

    def manifest(self, version: int | None = None) -> dict:
        versions = self._versions(self.spark, self.root)
        if version is None and not versions:
            return {"version": 0, "batch": None, "schema": {}, "files": {f: {} for f in self.families}}
        at = versions[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/_manifests/v{at}").first()[0])

    def _family(self, m: dict, family: str, only: set[int] | None = None) -> DataFrame | None:
        files = {int(b): v for b, v in m["files"][family].items() if only is None or int(b) in only}
        if not files:
            return None
        schema = StructType.fromJson(m["schema"][family])
        paths = [f"{self.root}/{family}/v={v}/bucket={b}" for b, v in sorted(files.items())]
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, families: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The key and the columns of the families (all, if none are named), as of a version or the last."""
        m = self.manifest(version)
        out = None
        for family in families or list(self.families):
            part = self._family(m, family)
            if part is None:
                if family not in m["schema"]:
                    raise ValueError("no version has been written")
                part = self.spark.createDataFrame([], StructType.fromJson(m["schema"][family]))
            out = part if out is None else out.join(part, self.key)
        return out

    # changes --------------------------------------------------------------------------------------------------------

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.key]), F.lit(self.buckets)).cast("int")

    def _checked(self, rows: DataFrame) -> tuple[DataFrame, set[int]]:
        """The rows, and their buckets: at most ``buckets`` numbers."""
        known = rows.select(F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in self.key], F.lit(0)) == 0, self._bucket()).alias("bucket"))
        touched = {r.bucket for r in known.distinct().collect()}
        if None in touched:
            raise ValueError(f"a row has no {' or '.join(self.key)}")
        return rows, touched

    def _commit(self, m: dict, family_rows: dict[str, DataFrame], touched: set[int], batch: int | None) -> None:
        version = m["version"] + 1
        m = m | {"version": version, "batch": batch if batch is not None else m["batch"], "key": self.key, "families": self.families, "buckets": self.buckets}
        for family, rows in family_rows.items():
            target = f"{self.root}/{family}/v={version}"
            rows = rows.select(*self.key, *self.families[family])
            # a large bucket is written by several tasks, small ones are not split
            rows.withColumn("bucket", self._bucket()).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").mode("overwrite").parquet(target)
            fs, p = _path(self.spark, target)
            written = {int(n[7:]) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("bucket=")}
            kept = {b: v for b, v in m["files"].get(family, {}).items() if int(b) not in touched}
            m["files"] = m["files"] | {family: kept | {str(b): version for b in written}}
            m["schema"] = m["schema"] | {family: rows.schema.jsonValue()}
        self.spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/_manifests/v{version}")

    def _applied(self, m: dict, batch: int | None) -> bool:
        return batch is not None and m["batch"] is not None and m["batch"] >= batch

    def upsert(self, rows: DataFrame, batch: int | None = None, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, leaving: DataFrame | None = None) -> set[int]:
        """New rows replace those of their key, or ``merge(old, new)`` says what becomes of the touched buckets' rows.

        The rows of the keys ``leaving`` go from all families in the same change, which writes a bucket once.

        ``rows`` holds the columns of all families, or of some: then keys that the table hasn't got are left out.  A ``batch`` that was applied
        before changes nothing.  Keys of ``rows`` must be distinct unless ``merge`` makes them so.  Returns the buckets written.
        """
        m = self.manifest()
        if self._applied(m, batch):
            return set()
        named = [f for f, columns in self.families.items() if set(columns) <= set(rows.columns)]
        if not named:
            raise ValueError("rows have the columns of no family")
        if merge is not None and len(self.families) > 1:
            raise ValueError("merge needs a table of one family")
        if leaving is not None and (merge is not None or len(named) < len(self.families)):
            raise ValueError("rows leave with a change of all families only")
        rows, touched = self._checked(rows)
        gone = rows.select(*self.key)
        if leaving is not None:
            leaving, more = self._checked(leaving.select(*self.key))
            gone, touched = gone.unionByName(leaving), touched | more
        if len(named) < len(self.families):
            there = self._family(m, next(f for f in self.families if f not in named), touched)
            rows = rows.limit(0) if there is None else rows.join(there.select(*self.key), self.key, "left_semi")
        changed = {}
        for family in named:
            new = rows.select(*self.key, *self.families[family])
            old = self._family(m, family, touched)
            if merge is not None:
                new = merge(old if old is not None else new.limit(0), new)
            elif old is not None:
                new = old.join(gone, self.key, "left_anti").unionByName(new)
            changed[family] = new
        self._commit(m, changed, touched, batch)
        return touched

    def delete(self, keys: DataFrame, batch: int | None = None) -> set[int]:
        """The rows of the keys go from all families."""
        m = self.manifest()
        if self._applied(m, batch) or not m["schema"]:
            return set()
        keys, touched = self._checked(keys.select(*self.key))
        changed = {}
        for family in self.families:
            old = self._family(m, family, touched)
            if old is not None:
                changed[family] = old.join(keys, self.key, "left_anti")
        self._commit(m, changed, touched, batch)
        return touched

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what the last ``keep`` manifests don't name; returns how many folders went."""
        versions, gone = self._versions(self.spark, self.root), 0
        named = {(f, v) for n in versions[-keep:] for f, files in self.manifest(n)["files"].items() for v in files.values()}
        for n in versions[:-keep]:
            fs, p = _path(self.spark, f"{self.root}/_manifests/v{n}")
            gone += fs.delete(p, True)
        for family in self.families:
            fs, p = _path(self.spark, f"{self.root}/{family}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                found = re.fullmatch(r"v=(\d+)", s.getPath().getName())
                if found and versions and int(found[1]) <= versions[-1] and (family, int(found[1])) not in named:
                    gone += fs.delete(s.getPath(), True)
        return gone
