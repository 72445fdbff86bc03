"""Tables that change together: new files beside the old ones, and one small file that makes them the current version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import tables

BUCKETS = 64
#: Columns whose hash gives a row's bucket.
DOCUMENT = ("collection", "doc_id")
Step = Callable[[str], None]
#: Rows that are made from tables of the version under way: it gets a function from the name of a table to its new rows.
Derived = Callable[[Callable[[str], DataFrame]], DataFrame]


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


class VersionedTables:
    """Named tables below one folder, of which all readers see one version.

    A row's bucket is the hash of its document (or of the columns that `by` names for its table). A change writes new rows, and anew the buckets that it takes rows
    from, into a folder of its own; the manifest of a version names the folders of each bucket, and the greatest manifest is the version. A manifest appears
    by one rename, after all its files: whatever breaks before leaves the old version as it was. One writer at a time is assumed; a
    second one that would publish the same version gets a Conflict where the file system's rename tells it.
    A change may carry a mark (name, number): a number that isn't above the last one under that name changes nothing, so a micro-batch that comes twice counts once.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, by: Mapping[str, Sequence[str]] | None = None):
        self.spark, self.path, self.by = spark, path.rstrip("/"), dict(by or {})
        self.buckets = self.manifest().get("buckets", buckets)

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the current one without; empty if there is none."""
        if version is None:
            found = self.versions()
            if not found:
                return {}
            version = found[-1]
        return json.loads(tables.read_text(self.spark, f"{self.path}/manifest-{version:020d}.json"))

    def versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in tables.names(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json"))

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        """The rows of a table, None if it was never written."""
        held = self.manifest(version).get("tables", {}).get(name)
        return None if held is None else self._read(name, held)

    def _read(self, name: str, held: dict, only: Collection[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(held["schema"])
        paths = [f"{self.path}/{name}/{folder}/bucket={k}" for k, folders in held["buckets"].items() if only is None or int(k) in only for folder in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.by.get(name, DOCUMENT)), F.lit(self.buckets)).cast("int")

    def applied(self, mark: tuple[str, int]) -> bool:
        return self.manifest().get("marks", {}).get(mark[0], -1) >= mark[1]

    def change(
        self, fresh: Mapping[str, DataFrame | Derived] | None = None, gone: Mapping[str, tuple[DataFrame, Sequence[str]]] | None = None, reset: Sequence[str] = (), mark: tuple[str, int] | None = None, step: Step | None = None, dealt: Collection[str] = (),
    ) -> dict[str, int]:
        """Publishes one version in which each table loses the rows that agree with a row of gone (keys, their columns), then gains those of fresh.

        Tables of `reset` lose all their rows first. Returns how many rows each table of gone or reset lost. Null keys agree with null keys. Columns that a
        table doesn't have yet are added, as nulls in older rows. step is told each step before it is taken. Tables are written in the order of fresh; a function
        in place of rows makes them from tables that were written before it. Rows of tables in `dealt` lie by bucket already (a task holds few of them) and aren't dealt again.
        """
        step, fresh, gone = step or (lambda _: None), dict(fresh or {}), dict(gone or {})
        old = self.manifest()
        if mark and old.get("marks", {}).get(mark[0], -1) >= mark[1]:
            return {}
        new = {"version": old.get("version", -1) + 1, "buckets": self.buckets, "tables": dict(old.get("tables", {})), "marks": dict(old.get("marks", {}))}
        lost: dict[str, int] = {}
        now = lambda name: self._read(name, new["tables"][name])
        for name in [*fresh, *sorted({*gone, *reset} - {*fresh})]:
            step(f"plan {name}")
            held = new["tables"].get(name)
            parts, touched = [], set()
            if held is not None and name in reset:
                lost[name], held = self._read(name, held).count(), held | {"buckets": {}}
            elif held is not None and name in gone:
                keys, on = gone[name]
                leaving = self._matched(self._read(name, held), keys, on, "left_semi").groupBy(self.bucket(name).alias("b")).count().collect()  # buckets at most
                touched, lost[name] = {r["b"] for r in leaving}, sum(r["count"] for r in leaving)
                if touched:
                    parts.append(self._matched(self._read(name, held, touched), keys, on, "left_anti"))
            if name in fresh:
                parts.append(fresh[name](now) if callable(fresh[name]) else fresh[name])
            there: set[str] = set()
            folder = f"{new['version']:08d}-{uuid.uuid4().hex}"
            schema = held["schema"] if held else None
            if parts:
                own = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
                if held:  # all columns that the table has had, and the new ones
                    own = self.spark.createDataFrame([], T.StructType.fromJson(held["schema"])).unionByName(own, allowMissingColumns=True)
                step(f"write {name}")
                own = own.withColumn("bucket", self.bucket(name))
                (own if name in dealt else own.hint("rebalance", "bucket")).sortWithinPartitions("bucket", *self.by.get(name, DOCUMENT)).write.partitionBy("bucket").parquet(f"{self.path}/{name}/{folder}")
                there = {n[7:] for n in tables.names(self.spark, f"{self.path}/{name}/{folder}") if n.startswith("bucket=")}
                schema = json.loads(own.drop("bucket").schema.json())
            if held or parts:
                current = {} if held is None else {k: f for k, f in held["buckets"].items() if int(k) not in touched}
                new["tables"][name] = {"schema": schema, "buckets": current | {k: [*current.get(k, []), folder] for k in sorted(there)}}
        if mark:
            new["marks"][mark[0]] = mark[1]
        step("publish")
        if not tables.publish_text(self.spark, f"{self.path}/manifest-{new['version']:020d}.json", json.dumps(new)):
            raise Conflict(f"version {new['version']} of {self.path} is there already")
        step("published")
        return lost

    @staticmethod
    def _matched(rows: DataFrame, keys: DataFrame, on: Sequence[str], how: str) -> DataFrame:
        own = keys.select(*[F.col(c).alias(f"_gone_{c}") for c in on]).distinct()
        same = F.lit(True)
        for c in on:
            same = same & rows[c].eqNullSafe(own[f"_gone_{c}"])
        return rows.join(own, same, how)

    def upsert(self, name: str, fresh: DataFrame, keys: Sequence[str], **how) -> dict[str, int]:
        """fresh in place of the rows with the same keys, wherever they stand; of rows of equal keys in fresh the greatest by all columns counts."""
        rows = fresh.groupBy(*keys).agg(F.max(F.struct(*fresh.columns)).alias("_row")).select("_row.*")
        rows = tables.written(rows, name)
        return self.change({name: rows}, {name: (rows, keys)}, **how)

    def replace_documents(self, fresh: Mapping[str, DataFrame], documents: DataFrame, **how) -> dict[str, int]:
        """In every table that is there or in fresh: all rows of `documents` (collection, doc_id) go, fresh ones come, at once."""
        documents = tables.written(documents.select(*DOCUMENT).distinct(), "documents")
        every = {n for n in {*self.manifest().get("tables", {}), *fresh} if n not in self.by}
        return self.change(fresh, {n: (documents, DOCUMENT) for n in every}, **how)

    def delete_documents(self, documents: DataFrame, **how) -> dict[str, int]:
        """All rows of `documents` in every table go at once; returns how many in each."""
        return self.replace_documents({}, documents, **how)

    def drop_collections(self, gone: DataFrame, **how) -> dict[str, int]:
        """All rows of the collections in `gone` in every table go at once; returns how many in each."""
        names = tables.written(gone.select("collection").distinct(), "collections")
        return self.change({}, {n: (names, ["collection"]) for n in self.manifest().get("tables", {}) if n not in self.by}, **how)

    def compact(self, name: str, rows: DataFrame | None = None, **how) -> None:
        """Writes a table anew, one folder in all: its own rows, or `rows` in their place."""
        self.change({name: self.table(name) if rows is None else rows}, reset=[name], **how)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests but the last `keep`, and folders that none of these names; returns how many folders went. No writer may be at work."""
        found = self.versions()
        used: dict[str, set[str]] = {}
        for version in found[-keep:]:
            for name, held in self.manifest(version)["tables"].items():
                used.setdefault(name, set()).update(f for folders in held["buckets"].values() for f in folders)
        for version in found[:-keep]:
            tables.remove(self.spark, f"{self.path}/manifest-{version:020d}.json")
        went = 0
        for name in (n for n in tables.names(self.spark, self.path) if not n.startswith("manifest-")):
            for folder in set(tables.names(self.spark, f"{self.path}/{name}")) - used.get(name, set()):
                tables.remove(self.spark, f"{self.path}/{name}/{folder}")
                went += 1
        return went
