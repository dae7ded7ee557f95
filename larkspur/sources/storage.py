"""Stored collections: immutable Parquet generations and one manifest a revision.

A manifest HEAD-<revision>.json names the folder of the data: one for the snapshot layout, one for each bucket (by the id's SHA-256) for the
bucketed layout, where a write only rewrites and counts the buckets that it touches, and the indexes read their postings and the changed rows only. A manifest is written
beside its name and renamed without overwriting, so a reader finds a whole one or none, and a commit fails
if another writer was first; it is then computed anew from the new state. Paths are Hadoop paths, so every file system that Spark
reads holds collections; on an object store without atomic rename a lock is needed besides.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Collection, check_name
from ..functions.values import id_bucket
from ..operators import index as index_tables
from ..operators.lifecycle import MARKS
from ..plans.ast import REFERENCE, Limits, QueryError
from ..plans.compile import Typed
from ..plans.planner import Index

RETRIES = 40


class Conflict(RuntimeError):
    """Other writers were first each time."""


@dataclass(frozen=True)
class Head:
    revision: int = 0
    layout: str = "snapshot"
    parts: dict = field(default_factory=dict)  # bucket ("" for a snapshot) to folder
    records: int = 0
    tombstones: int = 0
    indexes: dict = field(default_factory=dict)
    counts: dict = field(default_factory=dict)  # bucket to [records, tombstones]
    written: dict = field(default_factory=dict)  # generation to how many buckets were written there
    digits: int = 2  # hex digits of the id's hash that name a bucket


def bucket_digits(records: int) -> int:
    """Buckets follow the size: 16, 256 or 4,096."""
    return 1 if records < 100_000 else 2 if records < 100_000_000 else 3


def definition(i: Index) -> dict:
    return {"name": i.name, "keys": list(i.keys), "mode": i.mode, "include": list(i.include)}


def _live(rows: DataFrame) -> DataFrame:
    rows = rows.drop("bucket")
    return rows.where(F.col("deleted_at").isNull()).drop(*MARKS) if "deleted_at" in rows.columns else rows


class Store:
    """Collections of one scope below a root folder."""

    def __init__(self, spark: SparkSession, root: str, scope: str = "public"):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{scope.replace(':', '/')}"
        self._jvm = spark.sparkContext._jvm

    def _path(self, *parts: str):
        path = self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self, name: str) -> list[int]:
        path, fs = self._path(check_name(name))
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(f[5:-5]) for f in found if f.startswith("HEAD-") and f.endswith(".json"))

    def head(self, name: str) -> Head:
        revisions = self._manifests(name)
        if not revisions:
            return Head()
        path, fs = self._path(name, f"HEAD-{revisions[-1]:012d}.json")
        stream = fs.open(path)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Head(**json.loads(text))

    def _publish(self, name: str, head: Head) -> bool:
        path, _ = self._path(name, f"HEAD-{head.revision:012d}.json")
        beside, fs = self._path(name, f"_{uuid.uuid4().hex}")
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(head.__dict__, sort_keys=True).encode()))
        out.close()
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(beside, path, options)
        except Exception as e:  # py4j wraps FileAlreadyExistsException
            fs.delete(beside, False)
            if "exist" in str(e):
                return False
            raise
        return True

    def read(self, name: str, id_: str | None = None, head: Head | None = None) -> DataFrame | None:
        """Stored rows; with an id only those of its bucket. None for a collection that doesn't exist."""
        head = head or self.head(name)
        parts = head.parts
        if id_ is not None and head.layout == "bucketed":
            import hashlib

            bucket = hashlib.sha256(id_.encode()).hexdigest()[: head.digits]
            parts = {bucket: parts[bucket]} if bucket in parts else dict(list(parts.items())[:1])
        if not parts:
            return None
        rows = self._read(parts, head.written)
        return rows if id_ is None else rows.where(F.col("id") == id_)

    def _read(self, parts: dict, written: dict) -> DataFrame:
        """Rows of the parts. A generation of which all buckets are asked for is read as one folder."""
        by_generation: dict[str, list[str]] = {}
        for path in sorted(set(parts.values())):
            by_generation.setdefault(path.rsplit("/bucket=", 1)[0], []).append(path)
        out = None
        for generation, paths in by_generation.items():
            whole = len(paths) == written.get(generation)
            rows = self.spark.read.parquet(generation).drop("bucket") if whole else self.spark.read.parquet(*paths)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def commit(
        self, name: str, change: Callable[[DataFrame | None], DataFrame], layout: str | None = None, touched: DataFrame | None = None, indexes: tuple[Index, ...] | None = None, expected_revision: int | None = None
    ) -> Head:
        """Replace the stored rows by change(rows). touched: ids beyond which the change does nothing; a bucketed collection rewrites their buckets only.

        indexes: what the writer has configured; None: none. A write is refused where the manifest holds others, so that no index falls behind
        (`configure` changes them). expected_revision: write only if nothing was written since.
        """
        for _ in range(RETRIES):
            head = self.head(name)
            if expected_revision is not None and head.revision != expected_revision:
                raise Conflict(f"{name} is at revision {head.revision}, not {expected_revision}")
            held = {k: v["definition"] for k, v in head.indexes.items()}
            configured = {i.name: definition(i) for i in indexes or ()}
            if head.revision and held != configured:
                raise QueryError(f"{name}: the configured indexes differ from those of the collection")
            kind = layout or head.layout
            revision = head.revision + 1
            generation = f"{self.root}/{name}/gen-{revision:012d}-{uuid.uuid4().hex}"
            digits = head.digits if head.layout == "bucketed" else bucket_digits(head.records) if head.revision else 2
            ids = None
            if kind == "snapshot":
                change(self.read(name, head=head)).write.parquet(generation)
                parts, counts, written = {"": generation}, {"": self._counted(generation).first()[:2]}, {generation: 1}
            else:
                kept, rows = self._bucketed(name, head, touched)
                change(rows).withColumn("bucket", id_bucket(F.col("id"), digits)).repartition("bucket").write.partitionBy("bucket").parquet(generation)
                folder, fs = self._path(name, generation.rsplit("/", 1)[1])
                some = any(f.getPath().getName().startswith("bucket=") for f in fs.listStatus(folder))  # no rows, no files
                made = {r["bucket"]: [r["n"], r["gone"]] for r in self._counted(generation, "bucket").collect()} if some else {}  # a row for each bucket
                parts = kept | {b: f"{generation}/bucket={b}" for b in made}
                counts = {b: head.counts[b] for b in kept} | made
                written = {g: n for g, n in head.written.items() if any(p.startswith(g + "/") for p in kept.values())} | ({generation: len(made)} if made else {})
                ids = touched.select("id").distinct() if touched is not None and kept is not None and head.layout == "bucketed" else None
            after = Head(revision, kind, parts, sum(c[0] for c in counts.values()), sum(c[1] for c in counts.values()), {}, {b: list(c) for b, c in counts.items()}, written, digits)
            after = replace(after, indexes=self._write_indexes(after, generation, indexes or (), head if ids is not None else None, ids))
            if self._publish(name, after):
                return after
        raise Conflict(f"{name}: {RETRIES} commits in a row came second")

    def configure(self, name: str, indexes: tuple[Index, ...]) -> Head:
        """Build the indexes anew from the stored rows and make them those of the collection."""
        for _ in range(RETRIES):
            head = self.head(name)
            revision = head.revision + 1
            generation = f"{self.root}/{name}/gen-{revision:012d}-{uuid.uuid4().hex}"
            after = replace(head, revision=revision, indexes=self._write_indexes(head, generation, indexes))
            if self._publish(name, after):
                return after
        raise Conflict(f"{name}: {RETRIES} commits in a row came second")

    def _write_indexes(self, head: Head, generation: str, indexes: tuple[Index, ...], before: Head | None = None, ids: DataFrame | None = None) -> dict:
        """Postings of all indexes. With the state before and the ids that a write touched, the old postings are kept but for those of the ids."""
        out = {}
        for i in indexes if head.parts else ():
            rows = _live(self._read(head.parts, head.written))
            form = Typed(rows.schema)
            if before is not None and i.name in before.indexes:
                changed = {b: p for b, p in head.parts.items() if before.parts.get(b) != p}
                new = _live(self._read(changed, head.written)).join(ids, "id", "left_semi") if changed else rows.limit(0)
                kept = self.spark.read.parquet(before.indexes[i.name]["path"]).join(ids, "id", "left_anti")
                postings = kept.unionByName(index_tables.build(new, i, form))
            else:
                postings = index_tables.build(rows, i, form)
            path = f"{generation}-{i.name}"
            index_tables.write(postings, i, path)
            entries = index_tables.stats(self.spark.read.parquet(path), i).first()["entries"]
            out[i.name] = {"definition": definition(i), "path": path, "entries": entries}
        return out

    def collection(self, name: str, indexes: tuple[Index, ...] = (), limits: Limits = REFERENCE, binary_safe=()) -> Collection:
        """The live documents as a collection: its plans use the indexes that the manifest holds as configured, and scan where one is missing."""
        head = self.head(name)
        rows = self.read(name, head=head)
        if rows is None:
            raise QueryError(f"No such collection: {name}")
        usable = {i.name: head.indexes[i.name]["path"] for i in indexes if i.name in head.indexes and head.indexes[i.name]["definition"] == definition(i)}
        coverings = {n: self.spark.read.parquet(p) for n, p in usable.items()}
        return Collection.typed(name, _live(rows), indexes=indexes, limits=limits, binary_safe=binary_safe, coverings=coverings, available=frozenset(usable))

    def _bucketed(self, name: str, head: Head, touched: DataFrame | None) -> tuple[dict, DataFrame | None]:
        """(parts that stay, rows of the others). At most 4,096 bucket names reach the driver."""
        if head.layout != "bucketed" or touched is None:
            return {}, self.read(name, head=head)
        hit = {r[0] for r in touched.select(id_bucket(F.col("id"), head.digits)).distinct().collect()}
        old = [p for b, p in head.parts.items() if b in hit]
        if not old and head.parts:
            return dict(head.parts), self.read(name, head=head).limit(0)
        return {b: p for b, p in head.parts.items() if b not in hit}, self._read({p: p for p in old}, head.written) if old else None

    def _counted(self, generation: str, *by: str) -> DataFrame:
        """([bucket,] n, gone) of the rows written to a generation."""
        rows = self.spark.read.parquet(generation)
        gone = F.count_if(F.col("deleted_at").isNotNull()) if "deleted_at" in rows.columns else F.lit(0).cast("long")
        bucket = F.regexp_extract(F.col("_metadata.file_path"), "/bucket=([^/]+)/", 1).alias("bucket")  # as named, not as a number
        return rows.groupBy(*([bucket] if by else [])).agg(F.count(F.lit(1)).alias("n"), gone.alias("gone"))

    def bounded(self, name: str, most_records: int, most_tombstones: int = 1_000) -> DataFrame | None:
        """Stored rows, refused by the manifest's counts before anything is read."""
        head = self.head(name)
        if head.records > most_records or head.tombstones > most_tombstones:
            raise QueryError(f"{name} holds {head.records} records and {head.tombstones} deletions, above the maximum")
        return self.read(name, head=head)

    def compact(self, name: str, keep_manifests: int = 1) -> int:
        """Delete generations that the last manifests don't name, and older manifests. Only while no one writes. Returns how many folders went."""
        revisions = self._manifests(name)
        used = set()
        for r in revisions[-keep_manifests:]:
            path, fs = self._path(name, f"HEAD-{r:012d}.json")
            stream = fs.open(path)
            manifest = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            used |= {p.split("/gen-")[1].split("/")[0] for p in [*manifest["parts"].values(), *(i["path"] for i in manifest["indexes"].values())]}
            stream.close()
        path, fs = self._path(name)
        gone = 0
        for s in fs.listStatus(path) if revisions else []:
            file = s.getPath().getName()
            old = (file.startswith("gen-") and file[4:] not in used) or (file.startswith("HEAD-") and int(file[5:-5]) not in revisions[-keep_manifests:])
            if old:
                fs.delete(s.getPath(), True)
                gone += file.startswith("gen-")
        return gone

    def drop(self, name: str) -> None:
        path, fs = self._path(check_name(name))
        fs.delete(path, True)



__all__ = ["Conflict", "Head", "Store"]
