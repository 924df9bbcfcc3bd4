"""The dedup store on disk, in cells by key hash and time.

A cell holds the keys of one part (hash of the key) whose time lies in one bucket. A write replaces the cells
that its keys leave or enter and nothing else; a prune reads the buckets that can hold expired keys, and
replaces the cells it takes keys from. Every update writes its cells under its own number and then a
manifest that says which version of each cell counts, so readers see an update whole or not at all,
and an update that is repeated gives the same store again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.config import DEFAULTS
from clipledger.session import durable
from clipledger.sources.stores import KEY, dedup_store_upsert, expired

Cells = dict[tuple[int, int], int]


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, on any file system Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [f.getPath().toString() for f in found]


class KeyedStore:
    """A store of (scope_id, tweet_id) -> ts in a shared folder; ``n_parts`` and ``bucket_s`` are fixed when it is begun."""

    def __init__(
        self, spark: SparkSession, where: str, n_parts: int = 64, bucket_s: int = 6 * 3600, key_type: str = "scope_id bigint, tweet_id bigint"
    ):
        self.spark, self.where, self.n_parts, self.bucket_s = spark, where, n_parts, bucket_s
        self.schema = f"{key_type}, ts bigint"
        held = self._manifest(self.last())
        if held:
            self.n_parts, self.bucket_s, self.schema = held["n_parts"], held["bucket_s"], held["schema"]

    # --- manifests

    def versions(self) -> list[int]:
        """Numbers of finished updates."""
        return sorted(int(f.split("/")[-2][1:]) for f in _folders(self.spark, f"{self.where}/manifest/v*/_SUCCESS"))

    def last(self) -> int | None:
        return max(self.versions(), default=None)

    def _manifest(self, version: int | None) -> dict:
        if version is None:
            return {}
        return json.loads(self.spark.read.text(f"{self.where}/manifest/v{version}").first()[0])

    def cells(self, version: int | None) -> Cells:
        return {(p, b): v for p, b, v in self._manifest(version).get("cells", [])}

    def _commit(self, version: int, cells: Cells) -> None:
        said = {"n_parts": self.n_parts, "bucket_s": self.bucket_s, "schema": self.schema, "cells": sorted((*c, v) for c, v in cells.items())}
        self.spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.where}/manifest/v{version}")

    # --- rows

    def _read(self, cells: Cells) -> DataFrame:
        """Key, ts, part and bucket of these cells; part and bucket are folders, so filters on them choose what is read."""
        if not cells:
            return self.spark.createDataFrame([], f"{self.schema}, part int, bucket bigint")
        by_version: dict[int, list[str]] = {}
        for (p, b), v in sorted(cells.items()):
            by_version.setdefault(v, []).append(f"{self.where}/data/v{v}/part={p}/bucket={b}")
        out = None
        for v, own in by_version.items():
            rows = self.spark.read.schema(f"{self.schema}, part int, bucket bigint").option("basePath", f"{self.where}/data/v{v}").parquet(*own)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _placed(self, rows: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64(*KEY), F.lit(self.n_parts)).cast("int")
        return rows.select(*KEY, "ts", part.alias("part"), F.floor(F.col("ts") / self.bucket_s).cast("bigint").alias("bucket"))

    def read(self) -> DataFrame:
        """The store after its last update: scope_id, tweet_id, ts."""
        return self._read(self.cells(self.last())).select(*KEY, "ts")

    def live(self, now_s: int, ttl_s: int = DEFAULTS.dedup_ttl_s) -> DataFrame:
        """Keys still live at ``now_s``; only buckets that can hold such are read."""
        low = (now_s - ttl_s) // self.bucket_s
        held = {c: v for c, v in self.cells(self.last()).items() if c[1] >= low}
        return self._read(held).where(~expired(now_s, ttl_s)).select(*KEY)

    def _replace(self, version: int, cells: Cells, changed: set[tuple[int, int]], rows: DataFrame) -> None:
        """Puts rows in place of the changed cells."""
        path = f"{self.where}/data/v{version}"
        rows.repartition("part", "bucket").write.mode("overwrite").partitionBy("part", "bucket").parquet(path)
        made = set()
        for folder in _folders(self.spark, f"{path}/part=*/bucket=*"):
            part, bucket = folder.split("/")[-2:]
            made.add((int(part.split("=")[1]), int(bucket.split("=")[1])))
        self._commit(version, {c: v for c, v in cells.items() if c not in changed} | dict.fromkeys(made, version))

    def _base(self, version: int | None) -> tuple[int, int | None]:
        """An update's number and the one it builds on: a repeated one builds on what it did before."""
        done = self.versions()
        version = max(done, default=-1) + 1 if version is None else version
        return version, max((v for v in done if v < version), default=None)

    # --- updates

    def upsert(self, batch: DataFrame, version: int | None = None) -> None:
        """Writes (scope_id, tweet_id, ts, batch_no); the last of a key wins, over the store as well."""
        version, base = self._base(version)
        cells = self.cells(base)
        writes = durable(self._placed(dedup_store_upsert(None, batch)))
        enters = {tuple(r) for r in writes.select("part", "bucket").distinct().collect()}  # cells, not keys
        touched = {p for p, _ in enters}
        own = self._read({c: v for c, v in cells.items() if c[0] in touched})
        same = [own[k].eqNullSafe(writes[k]) for k in KEY]
        leaves = {tuple(r) for r in own.join(writes, same, "left_semi").select("part", "bucket").distinct().collect()}
        changed = enters | leaves
        old = self._read({c: v for c, v in cells.items() if c in changed})
        stay = old.join(writes, [old[k].eqNullSafe(writes[k]) for k in KEY], "left_anti")
        self._replace(version, cells, changed, stay.unionByName(writes))

    def expired(self, now_s: int, ttl_s: int = DEFAULTS.dedup_ttl_s, cells: Cells | None = None) -> DataFrame:
        """Keys that have expired, with their cells: no bucket is read that is live as a whole."""
        held = self.cells(self.last()) if cells is None else cells
        high = (now_s - ttl_s - 1) // self.bucket_s
        return self._read({c: v for c, v in held.items() if c[1] <= high}).where(expired(now_s, ttl_s))

    def prune(
        self, now_s: int, ttl_s: int = DEFAULTS.dedup_ttl_s, batch_size: int = DEFAULTS.prune_batch, version: int | None = None
    ) -> DataFrame:
        """Takes the first ``batch_size`` expired keys in key order out of the store and returns them."""
        version, base = self._base(version)
        cells = self.cells(base)
        removed = durable(self.expired(now_s, ttl_s, cells).orderBy(*KEY).limit(max(batch_size, 1)))
        changed = {tuple(r) for r in removed.select("part", "bucket").distinct().collect()}
        old = self._read({c: v for c, v in cells.items() if c in changed})
        stay = old.join(removed, [old[k].eqNullSafe(removed[k]) for k in KEY], "left_anti")
        self._replace(version, cells, changed, stay)
        return removed.select(*KEY)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Deletes cells that none of the last ``keep`` manifests names, and older manifests; returns the emptied versions."""
        done = self.versions()
        named = {v for m in done[-keep:] for v in self.cells(m).values()} | set(done[-keep:])
        gone = [v for v in done if v not in named]
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for v in done[:-keep]:
            for kind in ("manifest",) + (("data",) if v in gone else ()):
                path = jvm.Path(f"{self.where}/{kind}/v{v}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone
