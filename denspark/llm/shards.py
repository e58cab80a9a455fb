"""A table of immutable shards with size-tiered compaction and a versioned manifest.

Arrivals become small Parquet shards.  Compaction puts shards into tiers by size, merges
runs of one tier once there are enough of them, and goes on until no tier is full or a
run has reached the target size.  The merges are planned on sizes first, so each row is
written once for all levels.  A manifest names the live shards of a version; it is
written aside and renamed to a name that must not exist yet, so readers see a version
whole or not at all, and of two writers one starts again from the newer version.

Rows only pass through Spark's own readers and writers.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Merges that are written by one job.
MERGES_A_JOB = 64


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    rows: int
    level: int = 0


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class Conflict(RuntimeError):
    """Another writer has committed first."""


def plan_merges(sizes: list[int], target: int, fanout: int = 4, ratio: int = 4, base: int = 1 << 20) -> list[list[int]]:
    """Which shards to merge: lists of positions, each at most ``target`` in total.

    A run's tier is the power of ``ratio`` times ``base`` that its size is under.  Once a
    tier holds ``fanout`` runs, neighbours in it are merged as long as they stay within
    the target.  Runs of half the target or more are finished.
    """

    def tier(size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / base, ratio)))

    runs = [([i], size) for i, size in enumerate(sizes) if 2 * size < target]
    changed = True
    while changed:
        changed = False
        for t in sorted({tier(size) for _, size in runs}):
            own = [r for r in runs if tier(r[1]) == t]
            if len(own) < fanout:
                continue
            merged, held, total = [], [], 0
            for members, size in own:
                if held and total + size > target:
                    merged.append((held, total))
                    held, total = [], 0
                held, total = held + members, total + size
            merged.append((held, total))
            if len(merged) < len(own):
                runs = sorted([r for r in runs if tier(r[1]) != t] + merged)
                runs = [r for r in runs]
                changed = True
                break
        if changed and all(2 * size >= target for _, size in runs):
            break
    return sorted(members for members, _ in runs if len(members) > 1)


class ShardedTable:
    """``root`` holds ``data/`` with the shards and ``manifests/`` with a file for each version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _listed(self, folder: str) -> list[tuple[str, int]]:
        path = self._path(folder)
        if not self._files.exists(path):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self._files.listStatus(path) if s.isFile())

    # -- versions ---------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for name, _ in self._listed(f"{self.root}/manifests") if (m := re.fullmatch(r"v(\d+)\.json", name)))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, the latest by default; version 0 is the empty table."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return Manifest(0, "{}", ())
        stream = self._files.open(self._path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        head, *lines = text.splitlines()
        return Manifest(version, json.loads(head)["schema"], tuple(Shard(**json.loads(x)) for x in lines))

    def _commit(self, base: Manifest, schema: str, shards: tuple[Shard, ...]) -> Manifest:
        """Write version base + 1, or raise Conflict if it exists."""
        new = Manifest(base.version + 1, schema, shards)
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        final = self._path(f"{self.root}/manifests/v{new.version:010d}.json")
        stream = self._files.create(aside, True)
        try:
            stream.write(bytearray("\n".join([json.dumps({"version": new.version, "schema": schema}), *(json.dumps(asdict(s)) for s in shards)]).encode()))
            stream.hsync()
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf) if aside.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            context.rename(aside, final, options)
        except Exception as error:
            self._files.delete(aside, False)
            if self._files.exists(final):
                raise Conflict(f"version {new.version} exists") from error
            raise
        return new

    # -- writing ----------------------------------------------------------------------

    def _written(self, rows: DataFrame, level: int) -> dict[int, Shard]:
        """Write rows, a shard for each partition that has any; by partition."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        sizes = {f"{folder}/{name}": size for name, size in self._listed(folder) if name.startswith("part-")}
        counts = {}
        if sizes:
            held = self.spark.read.schema(rows.schema).parquet(folder).select(F.col("_metadata.file_name").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
            counts = {r["name"]: r["n"] for r in held.collect()}  # a row for each file of this call
        return {int(re.search(r"/part-(\d+)", path)[1]): Shard(path, size, counts[path.rpartition("/")[2]], level) for path, size in sorted(sizes.items()) if counts.get(path.rpartition("/")[2])}

    def append(self, rows: DataFrame) -> Manifest:
        """Add rows as new shards, one for each of their partitions. Rows aren't moved."""
        schema = rows.schema.json()
        now = self.manifest()
        if now.version and now.schema != schema:  # before anything is written
            raise ValueError("the rows' columns differ from the table's")
        new = tuple(self._written(rows, 0).values())
        while True:
            base = self.manifest()
            if base.version and base.schema != schema:
                raise ValueError("the rows' columns differ from the table's")
            try:
                return self._commit(base, schema, base.shards + new)
            except Conflict:
                continue  # shards are immutable: add them to the newer version

    def compact(self, target: int = 128 << 20, fanout: int = 4, ratio: int = 4, base_size: int = 1 << 20) -> Manifest:
        """Merge shards of like size into files of about ``target`` bytes and commit; shards of older versions stay readable."""
        while True:
            base = self.manifest()
            merges = plan_merges([s.size for s in base.shards], target, fanout, ratio, base_size)
            if not merges:
                return base
            schema = StructType.fromJson(json.loads(base.schema))
            merged: list[Shard] = []
            for a in range(0, len(merges), MERGES_A_JOB):
                batch = merges[a : a + MERGES_A_JOB]
                parts = [self.spark.read.schema(schema).parquet(*[base.shards[i].path for i in members]).coalesce(1) for members in batch]
                rows = parts[0]
                for other in parts[1:]:
                    rows = rows.union(other)
                new = self._written(rows, 1 + max(base.shards[i].level for members in batch for i in members))
                wrote, had = sum(s.rows for s in new.values()), sum(base.shards[i].rows for members in batch for i in members)
                if wrote != had:
                    raise RuntimeError(f"a merge wrote {wrote} of {had} rows")
                merged += new.values()
            gone = {i for members in merges for i in members}
            try:
                return self._commit(base, base.schema, (*(s for i, s in enumerate(base.shards) if i not in gone), *merged))
            except Conflict:
                for shard in merged:
                    self._files.delete(self._path(shard.path), False)

    def vacuum(self, keep: int = 1) -> int:
        """Delete shards and manifests that none of the last ``keep`` versions names; the number of shards deleted."""
        known = self.versions()
        live = {s.path for v in known[-keep:] for s in self.manifest(v).shards}
        dead = {s.path for v in known[:-keep] for s in self.manifest(v).shards} - live
        for path in sorted(dead):
            self._files.delete(self._path(path), False)
        for v in known[:-keep]:
            self._files.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        return len(dead)

    def sweep(self, older_than: float = 7 * 86400) -> int:
        """Delete files that no version names and that are older than so many seconds: what crashed or refused writers left; how many."""
        named = {self._files.makeQualified(self._path(s.path)).toString() for v in self.versions() for s in self.manifest(v).shards}
        data, before, gone = self._path(f"{self.root}/data"), 1000 * (time.time() - older_than), 0
        for folder in self._files.listStatus(data) if self._files.exists(data) else ():
            for status in self._files.listStatus(folder.getPath()):
                if status.getModificationTime() < before and self._files.makeQualified(status.getPath()).toString() not in named:
                    self._files.delete(status.getPath(), True)
                    gone += 1
        return gone

    # -- reading ----------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        manifest = self.manifest(version)
        if not manifest.version:
            raise ValueError("nothing has been committed yet")
        schema = StructType.fromJson(json.loads(manifest.schema))
        if not manifest.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.path for s in manifest.shards])


def shard(rows: DataFrame, root: str, target: int = 128 << 20, fanout: int = 4) -> ShardedTable:
    """Append rows to the table at ``root`` and compact it.

    Nulls, empty and long values and repeated rows are kept as they are; an empty table
    commits a version without shards.
    """
    table = ShardedTable(rows.sparkSession, root)
    table.append(rows)
    table.compact(target, fanout)
    return table
