"""Tables that are written in batches, each of which is there as a whole or not at all.

A batch writes its rows to a folder of its own, which nobody reads yet.  It counts
from the moment its manifest gets its name: a small file that lists the folders
of this version, made aside and renamed to the next free number, which fails if
another writer was first and is then tried again on top of that one's version.
Readers take the last manifest, or an older one; what a killed writer left behind
is in no manifest.

A writer numbers its batches.  A manifest keeps the last number of each writer, so
a batch that is sent again, after a crash or by a stream that restarts, is passed
over.  Rows replace those of older versions with the same keys; rows of one batch
that share their keys stay together; a batch can also delete keys.  Null keys are
keys like others.  An empty batch is a version without new rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors.exceptions.captured import CapturedException
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of a version from which on they are put together.
MOST_FOLDERS = 32
_TRIES = 20


class Conflict(RuntimeError):
    """Another writer took the number of a version."""


class VersionedTable:
    """A table at `path`, in any store that Spark can write to, whose rows are told apart by `keys`."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], most_folders: int = MOST_FOLDERS):
        self.spark, self.path, self.keys, self.most_folders = spark, path.rstrip("/"), keys, most_folders

    # what is in the store

    def _file(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _store(self):
        return self._file().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, *parts: str) -> list[tuple[str, int]]:
        """Names and times of what is in a folder; nothing if there is none."""
        store, folder = self._store(), self._file(*parts)
        found = store.listStatus(folder) if store.exists(folder) else []
        return [(x.getPath().getName(), x.getModificationTime()) for x in found]

    def versions(self) -> list[int]:
        return sorted(int(name.removesuffix(".json")) for name, _ in self._children("manifests") if name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of, by default the last one; version 0 is the table before its first batch."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return {"version": 0, "folders": {}, "deletes": {}, "last": {}, "schema": None}
        if version not in known:
            raise ValueError(f"there is no version {version}")
        stream = self._store().open(self._file("manifests", f"{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Gives a manifest its name, unless there is one of this name."""
        aside = self._file("manifests", f"_{uuid.uuid4().hex}")
        stream = self._store().create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, self._file("manifests", f"{manifest['version']:012d}.json"), options)
        except (Py4JJavaError, CapturedException) as error:
            self._store().delete(aside, False)
            if "FileAlreadyExistsException" in str(error):
                raise Conflict(f"version {manifest['version']} exists") from error
            raise

    # writing

    def commit(self, rows: DataFrame, writer: str = "", batch: int | None = None, deleted: DataFrame | None = None) -> int | None:
        """Adds a batch; its version, or nothing if the writer's batch of this number, or a later one, is there already."""
        if self._known(self.manifest(), writer, batch):
            return None
        missing = [k for k in self.keys if k not in rows.columns]
        if missing:
            raise ValueError(f"rows lack the keys {missing}")
        names = {"folders": uuid.uuid4().hex}
        rows.write.parquet(f"{self.path}/data/{names['folders']}")
        if deleted is not None:
            names["deletes"] = uuid.uuid4().hex
            deleted.select(*self.keys).write.parquet(f"{self.path}/data/{names['deletes']}")

        def after(now: dict) -> dict | None:
            if self._known(now, writer, batch):
                return None
            if now["schema"] and StructType.fromJson(now["schema"]).simpleString() != rows.schema.simpleString():
                raise ValueError("a batch has to have the columns of the table")
            new = self._next(now) | {"schema": now["schema"] or rows.schema.jsonValue()}
            for kind, name in names.items():
                new[kind] = now[kind] | {name: new["version"]}
            if batch is not None:
                new["last"] = now["last"] | {writer: batch}
            return new

        version = self._agree(after)
        if version is not None and len(self.manifest()["folders"]) > self.most_folders:
            self.compact()
        return version

    def _agree(self, change: Callable[[dict], dict | None]) -> int | None:
        """Publishes a change of the last manifest, again on top of what others publish meanwhile."""
        for _ in range(_TRIES):
            new = change(self.manifest())
            if new is None:
                return None
            try:
                self._publish(new)
                return new["version"]
            except Conflict:
                continue
        raise Conflict(f"{_TRIES} versions of others came first")

    @staticmethod
    def _known(manifest: dict, writer: str, batch: int | None) -> bool:
        return batch is not None and manifest["last"].get(writer, -1) >= batch

    @staticmethod
    def _next(manifest: dict) -> dict:
        return manifest | {"version": manifest["version"] + 1, "at": time.time()}

    def commit_each(self, work: DataFrame, batch: str, apply: Callable[[DataFrame], DataFrame], writer: str = "work") -> int:
        """Applies work batch by batch in the order of the numbers in the column `batch`, each its own version; a run after a crash goes on behind the last one. How many it did."""
        last = self.manifest()["last"].get(writer, -1)
        numbers = [r[0] for r in work.select(batch).where(F.col(batch) > last).distinct().orderBy(batch).toLocalIterator()]
        return sum(self.commit(apply(work.where(F.col(batch) == n).drop(batch)), writer, n) is not None for n in numbers)

    def sink(self, writer: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch of a stream: each micro-batch is a version, once."""

        def put(rows: DataFrame, epoch: int) -> None:
            self.commit(rows, writer, epoch)

        return put

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version: of each key those of the newest batch that has it and was not deleted since."""
        manifest = self.manifest(version)
        if not manifest["schema"]:
            raise ValueError("the table has no version yet")
        schema = StructType.fromJson(manifest["schema"])
        rows = self._scan(manifest["folders"], schema)
        if len(manifest["folders"]) == 1 and not manifest["deletes"]:
            return rows.drop("_version")
        newest = F.max("_version").over(Window.partitionBy(*self.keys))
        rows = rows.withColumn("_newest", newest).where("_version = _newest").drop("_newest")
        if manifest["deletes"]:
            gone = self._scan(manifest["deletes"], StructType([schema[k] for k in self.keys])).groupBy(*self.keys).agg(F.max("_version").alias("_gone"))
            same = [rows[k].eqNullSafe(gone[k]) for k in self.keys]
            rows = rows.join(gone, [*same, gone["_gone"] > rows["_version"]], "left_anti")
        return rows.drop("_version")

    def _scan(self, folders: dict[str, int], schema: StructType) -> DataFrame:
        """All folders in one scan, with the version each row came in; compaction bounds their number."""
        versions = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])
        name = F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]{32})/", 1)
        found = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders])
        return found.select(*schema.names, F.element_at(versions, name).alias("_version"))

    # upkeep

    def compact(self) -> int | None:
        """The same rows in one folder as a new version; nothing if another writer came first, whose batch then stays apart."""
        now = self.manifest()
        if len(now["folders"]) + len(now["deletes"]) < 2:
            return None
        name = uuid.uuid4().hex
        self.read(now["version"]).write.parquet(f"{self.path}/data/{name}")
        try:
            self._publish(self._next(now) | {"folders": {name: now["version"]}, "deletes": {}})
        except Conflict:
            return None
        return now["version"] + 1

    def vacuum(self, keep: int = 2, older_than: float = 86_400) -> list[str]:
        """Deletes all manifests but the last `keep`, and folders that none of these lists and that are `older_than` seconds old, so that no batch under way loses its own."""
        known, store = self.versions(), self._store()
        used = {name for v in known[-keep:] for kind in ("folders", "deletes") for name in self.manifest(v)[kind]}
        for v in known[:-keep]:
            store.delete(self._file("manifests", f"{v:012d}.json"), False)
        gone = [name for name, at in self._children("data") if name not in used and at / 1000 <= time.time() - older_than]
        for name in gone:
            store.delete(self._file("data", name), True)
        return gone
