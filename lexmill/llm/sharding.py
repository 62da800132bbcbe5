"""A store of immutable shards with size-tiered compaction and versioned manifests.

Method: size-tiered compaction. Arrivals are appended as small immutable shards. Compaction puts the shards that are
not yet of target size into tiers by size (each tier `fanout` times the one below) and, from the smallest tier up,
merges a tier's runs, if there are enough, into files of about the target size. A merge reads similarly sized files
packed up to the target into one task and writes one file, so rows are never shuffled and no file grows far above the
target. A version's manifest says what it added and removed (one row a shard); every `SNAPSHOT`th also has the whole
list. It is committed by one rename that fails if that version exists; a writer that lost the race tries again on the
newer version. Readers see the last whole version. `vacuum` deletes what the last version doesn't name, but nothing of
a writer that is still at work: each announces its folder before it writes there.

How it runs. Writes and reads are Spark's Parquet writer and reader; sizes and row counts come from the files' metadata
columns and manifests are small Parquet tables that Spark writes. The driver handles the names of shards below target
size (compaction) or of all shards (reading, since Spark's reader takes names), never rows; target_bytes should grow
with the store. A lost executor's task is run again by Spark's committer; a lost driver leaves files that no manifest
names, which vacuum takes after `abandoned_hours`.

Where a file system's rename doesn't fail on an existing target or isn't atomic (some object stores), one writer at a
time must be granted otherwise.

Defined results: rows are stored as they are, nulls, empty texts and repeated rows included, below any path. The store
has the columns of all arrivals, by name (letter case aside); rows of an arrival that lacks a column have null there.
An arrival whose column has another type than the store's is refused (ValueError), and nothing is committed. An empty
arrival commits a version without new shards.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import free_name

#: path: below the store's own.
_SHARDS = "path string, bytes long, rows long"
#: Every so many versions a manifest has the whole list.
SNAPSHOT = 10
#: How often a commit is tried again on a newer version.
TRIES = 20


def _plainly(path: str) -> str:
    """A path in which nothing is taken for a wildcard."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def merged_schema(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """Columns of both, the old ones first; all may be null."""
    fields = {f.name.lower(): f for f in (old.fields if old else ())}
    for f in new.fields:
        had = fields.setdefault(f.name.lower(), f)
        if had.dataType != f.dataType:
            raise ValueError(f"column {f.name!r} is {f.dataType.simpleString()}, the store has {had.dataType.simpleString()}")
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields.values()])


@contextmanager
def _packing(spark: SparkSession, most: int) -> Iterator[None]:
    """File scans pack whole small files up to so many bytes into a task."""
    keys = {"spark.sql.files.maxPartitionBytes": str(most), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass
class ShardStore:
    """Shards below a path that the whole cluster shares."""

    spark: SparkSession
    path: str
    target_bytes: int = 64 << 20
    fanout: int = 4
    arrival_rows: int = 4096
    compression: str = "zstd"

    def _file_system(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf)

    def version(self) -> int:
        """The last committed version; 0 if there is none."""
        jvm, fs, _ = self._file_system()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        if not fs.exists(folder):
            return 0
        return max((int(x.getPath().getName()[1:]) for x in fs.listStatus(folder) if x.getPath().getName().startswith("v")), default=0)

    def _part(self, version: int, part: str) -> DataFrame:
        return self.spark.read.schema(_SHARDS).parquet(_plainly(f"{self.path}/manifests/v{version:08d}/{part}"))

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, rows) of a version's shards; paths are below the store's."""
        version = self.version() if version is None else version
        base = version - version % SNAPSHOT
        live = self._part(base, "all") if base else self.spark.createDataFrame([], _SHARDS)
        for part in ("added", "removed"):
            since = [_plainly(f"{self.path}/manifests/v{v:08d}/{part}") for v in range(base + 1, version + 1)]
            if since:
                changed = self.spark.read.schema(_SHARDS).parquet(*since)
                live = live.unionByName(changed) if part == "added" else live.join(changed.select("path"), "path", "left_anti")
        return live

    def schema(self, version: int | None = None) -> T.StructType:
        """The columns of a version."""
        version = self.version() if version is None else version
        return T.StructType.fromJson(json.loads(self.spark.read.parquet(_plainly(f"{self.path}/manifests/v{version:08d}/schema")).first()["schema"]))

    def _commit(self, version: int, added: list[tuple[str, int, int]], schema: T.StructType, removed: list[tuple[str, int, int]] = ()) -> int:
        """Publishes changes as the given version, or raises if another writer has taken it."""
        jvm, fs, context = self._file_system()
        path, options = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options.Rename
        made = f"{self.path}/manifests/_new-{uuid.uuid4().hex}"
        new, old = (self.spark.createDataFrame(list(x), _SHARDS) for x in (added, removed))
        new.coalesce(1).write.parquet(f"{made}/added")
        old.coalesce(1).write.parquet(f"{made}/removed")
        if version % SNAPSHOT == 0:
            self.manifest(version - 1).unionByName(new).join(old.select("path"), "path", "left_anti").coalesce(1).write.parquet(f"{made}/all")
        self.spark.createDataFrame([(schema.json(),)], "schema string").coalesce(1).write.parquet(f"{made}/schema")
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        context.rename(path(made), path(f"{self.path}/manifests/v{version:08d}"), none)
        return version

    def _written(self, folder: str, schema: T.StructType) -> list[tuple[str, int, int]]:
        """Paths, sizes and rows of the shards in a folder."""
        files = self.spark.read.schema(schema).parquet(_plainly(f"{self.path}/{folder}")).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes"))
        return [(f"{folder}/{r['name']}", r["bytes"], r["rows"]) for r in files.groupBy("name", "bytes").agg(F.count("*").alias("rows")).orderBy("name").collect()]

    @contextmanager
    def _at_work(self) -> Iterator[str]:
        """A new folder that vacuum leaves alone until the writer is done with it."""
        jvm, fs, _ = self._file_system()
        name = uuid.uuid4().hex
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.path}/at-work/{name}")
        fs.create(mark).close()
        try:
            yield f"data/{name}"
        finally:
            fs.delete(mark, False)

    def append(self, rows: DataFrame) -> int:
        """Writes an arrival as small shards and commits them beside what is there; returns the version."""
        with self._at_work() as folder:
            schema = rows.schema
            if now := self.version():
                merged_schema(self.schema(now), schema)
            rows.write.option("maxRecordsPerFile", self.arrival_rows).option("compression", self.compression).parquet(f"{self.path}/{folder}")
            added = self._written(folder, schema)
            for _ in range(TRIES):
                now = self.version()
                try:
                    return self._commit(now + 1, added, merged_schema(self.schema(now) if now else None, schema))
                except Exception as e:
                    if isinstance(e, ValueError) or self.version() == now:
                        raise
        raise RuntimeError(f"other writers took {TRIES} versions in a row")

    def tier(self, size: int) -> int | None:
        """The tier of a shard; None if it is of target size already."""
        if size >= 0.75 * self.target_bytes:
            return None
        return int(math.log(max(size, 1), self.fanout))

    def compact(self, at_least: int | None = None) -> int:
        """Merges tiers that have `at_least` runs (fanout if not given), smallest first, and commits; returns the version."""
        now, enough = self.version(), self.fanout if at_least is None else at_least
        if not now:
            return 0
        schema, tiers = self.schema(now), {}
        for r in self.manifest(now).where(F.col("bytes") < 0.75 * self.target_bytes).collect():
            tiers.setdefault(self.tier(r["bytes"]), []).append(tuple(r))
        with self._at_work() as folder:
            gone, made = self._merge(tiers, enough, schema, folder)
            if not gone:
                return now
            kept, lost = [s for s in made if s[0] not in gone], [s for s in gone.values() if s[0].rsplit("/", 2)[0] != folder]
            for _ in range(TRIES):
                now = self.version()
                try:
                    # arrivals may have come since, but only one compaction may take a shard
                    there = self.manifest(now).join(self.spark.createDataFrame(lost, _SHARDS).select("path"), "path").count()
                    if there < len(lost):
                        raise RuntimeError("another compaction took the same shards")
                    return self._commit(now + 1, kept, self.schema(now), lost)
                except Exception:
                    if self.version() == now:
                        raise
        raise RuntimeError(f"other writers took {TRIES} versions in a row")

    def _merge(self, tiers: dict, enough: int, schema: T.StructType, folder: str) -> tuple[dict[str, tuple], list[tuple[str, int, int]]]:
        """Merged runs by path, and the shards that the merges made."""
        gone: dict[str, tuple] = {}
        made: list[tuple[str, int, int]] = []
        for t in sorted(tiers):
            runs = tiers[t] + [s for s in made if self.tier(s[1]) == t and s[0] not in gone]
            if len(runs) < max(2, enough):
                continue
            with _packing(self.spark, self.target_bytes):
                self.spark.read.schema(schema).parquet(*(_plainly(f"{self.path}/{s[0]}") for s in runs)).write.option("compression", self.compression).parquet(f"{self.path}/{folder}/{t}")
            gone |= {s[0]: s for s in runs}
            made += self._written(f"{folder}/{t}", schema)
        return gone, made

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with `_shard` (or the first free name that starts so), the name of the shard that holds each."""
        version = self.version() if version is None else version
        shards, schema = [r["path"] for r in self.manifest(version).orderBy("path").select("path").collect()], self.schema(version)
        found = self.spark.read.schema(schema).parquet(*(_plainly(f"{self.path}/{s}") for s in shards)) if shards else self.spark.createDataFrame([], schema)
        name = F.col("_metadata.file_name") if shards else F.lit(None).cast("string")
        return found.select("*", name.alias(free_name(found, "_shard")))

    def vacuum(self, abandoned_hours: float = 168.0) -> int:
        """Deletes shards that the last version doesn't name, except of writers at work. Returns their number.

        Readers of older versions must be done. A writer counts as lost when its mark is older than `abandoned_hours`.
        """
        jvm, fs, _ = self._file_system()
        path, n = jvm.org.apache.hadoop.fs.Path, 0
        root = fs.makeQualified(path(self.path)).toString().rstrip("/") + "/"
        data, marks = path(f"{self.path}/data"), path(f"{self.path}/at-work")
        if not fs.exists(data):
            return 0
        # in this order: what is listed here and unmarked afterwards was committed before the manifest is read, or never will be
        found, files = [], fs.listFiles(data, True)
        while files.hasNext():
            found.append(files.next().getPath())
        oldest = (time.time() - 3600 * abandoned_hours) * 1000
        working = {x.getPath().getName() for x in fs.listStatus(marks) if x.getModificationTime() >= oldest} if fs.exists(marks) else set()
        keep = {r["path"] for r in self.manifest().select("path").collect()}
        for f in found:
            below = f.toString()[len(root) :]
            if f.getName().startswith("part-") and below.split("/")[1] not in working and below not in keep:
                n += bool(fs.delete(f, False))
        return n
