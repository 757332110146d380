"""Keyed tables in buckets whose versions are swapped as a whole.

Rows lie in directories by hash of their key. A write puts the buckets it changes into a
directory of its own and then adds one manifest that names, for every bucket, the
directories that hold it now. Changed rows are written once and stay where they were
written; of a bucket they change, only rows that remain are written again. Readers take the newest manifest, so a write that fails
half-way, or is still running, leaves the table as it was, and a table being read does
not change. The manifest is put in place by one rename to a name that must not exist:
of two writers that start from one version the second is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.operators.tables import one_per_key
from docflow.session import MAX_BROADCAST_ROWS, at_most, broadcast_if_small, cut_lineage

BUCKETS = 256
FILES = 8  # of a bucket, so that a hot bucket is several files
STRAIGHT = 32  # up to so many buckets a task writes the rows it has, a file per bucket
_MANIFESTS = "_manifests"


class _Folder:
    """Files below a table's path, in whatever store the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file under a name that must not exist yet; False if it does."""
        draft, target = self._at(f"{_MANIFESTS}/.{uuid.uuid4().hex}"), self._at(name)
        stream = self.fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = not self.fs.exists(target) and self.fs.rename(draft, target)
        if not done:
            self.fs.delete(draft, False)
        return done

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class Conflict(RuntimeError):
    """Another writer changed the table in between."""


def _manifests(folder: _Folder) -> list[str]:
    return sorted(n for n in folder.names(_MANIFESTS) if n.endswith(".json") and not n.startswith("."))


def _newest(folder: _Folder) -> tuple[int, dict] | None:
    names = _manifests(folder)
    return (int(names[-1].split(".")[0]), json.loads(folder.read(f"{_MANIFESTS}/{names[-1]}"))) if names else None


def table_exists(spark: SparkSession, path: str) -> bool:
    return bool(_manifests(_Folder(spark, path)))


def with_bucket(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _write(folder: _Folder, rows: DataFrame, key: str, buckets: int) -> dict[str, str]:
    """Write rows to a directory of their own; its place per bucket that has rows.

    With few buckets a task's share of each is a file of fair size, and no row is
    shuffled. With many, rows are dealt out by bucket first.
    """
    name, laid = f"v-{uuid.uuid4().hex}", with_bucket(rows, key, buckets)
    if buckets > STRAIGHT:
        laid = laid.repartition("bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(FILES)))
    laid.write.partitionBy("bucket").parquet(f"{folder.path}/{name}")
    return {n.split("=")[1]: f"{name}/{n}" for n in folder.names(name) if n.startswith("bucket=")}


def _places(held: str | list[str]) -> list[str]:
    """Directories of a bucket; tables written before name a single one."""
    return [held] if isinstance(held, str) else held


def _commit(folder: _Folder, version: int, key: str, buckets: int, schema: T.StructType, data: dict[str, list[str]]) -> None:
    text = json.dumps({"key": key, "buckets": buckets, "schema": schema.jsonValue(), "data": data})
    if not folder.put(f"{_MANIFESTS}/{version:012d}.json", text):
        raise Conflict(f"version {version} of {folder.path} was written by another job")


def _rows(folder: _Folder, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    places = [p for b, held in manifest["data"].items() if buckets is None or b in buckets for p in _places(held)]
    if not places:
        return folder.spark.createDataFrame([], schema)
    return folder.spark.read.schema(schema).parquet(*[f"{folder.path}/{p}" for p in places])


def write_buckets(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Full write: the rows become the table's newest version."""
    folder = _Folder(df.sparkSession, path)
    before = _newest(folder)
    data = {b: [p] for b, p in _write(folder, df, key, buckets).items()}
    _commit(folder, before[0] + 1 if before else 1, key, buckets, df.schema, data)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; later writes do not change what this reads."""
    folder = _Folder(spark, path)
    found = _newest(folder)
    if found is None:
        raise ValueError(f"no table at {path}")
    return _rows(folder, found[1])


def _change(
    spark: SparkSession, path: str, changes: DataFrame, key: str, buckets: int, remaining, gone: DataFrame | None = None
) -> None:
    """Add ``changes`` and leave of their buckets' old rows what ``remaining(old rows, changed keys)`` gives.

    ``gone`` has keys that change without new rows. Both are written first, so they are
    computed once, whatever they come from; the directories they need name the buckets,
    and those of the changes become part of the table.
    """
    folder = _Folder(spark, path)
    version, manifest = _newest(folder) or (0, None)
    if manifest is None:
        raise ValueError(f"no table at {path}")
    if manifest["buckets"] != buckets:
        raise ValueError(f"{path} has {manifest['buckets']} buckets")
    empty = _rows(folder, manifest, []).unionByName(spark.createDataFrame([], changes.schema), allowMissingColumns=True)
    kinds = {f.name: f.dataType for f in empty.schema}
    staged = _write(folder, changes.select(*(F.col(c).cast(kinds[c]).alias(c) for c in changes.columns)), key, buckets)
    marked = {} if gone is None else _write(folder, gone.select(F.col(key).cast(kinds[key])), key, buckets)
    touched = {**marked, **staged}
    if not touched:
        return
    places = [f"{folder.path}/{p}" for p in (*staged.values(), *marked.values())]
    keys = spark.read.schema(T.StructType([empty.schema[key]])).parquet(*places)
    rows = remaining(_rows(folder, manifest, list(touched)), keys)
    data = _write(folder, rows.select(*(F.col(c).cast(kinds[c]).alias(c) for c in rows.columns)), key, buckets)
    left = {b: p for b, p in manifest["data"].items() if b not in touched}
    parts = {b: [part[b] for part in (data, staged) if b in part] for b in {**data, **staged}}
    _commit(folder, version + 1, key, buckets, empty.schema, {**left, **parts})
    if marked:
        folder.remove(next(iter(marked.values())).split("/")[0])


def upsert_path(
    spark: SparkSession, path: str, updates: DataFrame, key: str, buckets: int = BUCKETS, newest: str | None = None
) -> None:
    """Insert or replace by ``key``; only the buckets that change are read and written.

    Updates that repeat a key are refused, or with ``newest`` reduced to the row with
    the largest value in that column.
    """

    def remaining(old: DataFrame, keys: DataFrame) -> DataFrame:
        if newest is None and not keys.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"updates repeat a {key}")
        return old.join(broadcast_if_small(keys), key, "left_anti")

    _change(spark, path, updates if newest is None else one_per_key(updates, key, newest), key, buckets, remaining)


def replace_path(
    spark: SparkSession, path: str, new_chunks: DataFrame, buckets: int = BUCKETS, replaced: DataFrame | None = None
) -> None:
    """Replace whole documents in a table bucketed by ``doc_id``; safe to repeat.

    ``replaced`` (doc_id) names documents whose old rows go even if they have no new ones.
    """

    def remaining(old: DataFrame, keys: DataFrame) -> DataFrame:
        changed = keys.distinct()
        if at_most(changed, MAX_BROADCAST_ROWS):
            return old.join(F.broadcast(changed), "doc_id", "left_anti")
        stay = cut_lineage(old.select("doc_id").distinct().join(changed, "doc_id", "left_anti"))
        if at_most(stay, MAX_BROADCAST_ROWS):  # few documents remain: their ids travel, the rows do not
            return old.join(F.broadcast(stay), old["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")
        return old.join(changed, "doc_id", "left_anti")

    _change(spark, path, new_chunks, "doc_id", buckets, remaining, replaced)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete what only versions before the last ``keep`` use, and what failed writes left.

    Not to be run beside a writer or a reader of an older version.
    """
    folder = _Folder(spark, path)
    names = _manifests(folder)
    used = {p.split("/")[0] for n in names[-keep:] for held in json.loads(folder.read(f"{_MANIFESTS}/{n}"))["data"].values() for p in _places(held)}
    for n in names[:-keep]:
        folder.remove(f"{_MANIFESTS}/{n}")
    for n in folder.names(""):
        if n.startswith("v-") and n not in used:
            folder.remove(n)
