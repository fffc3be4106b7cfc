"""Small JSON documents in a shared folder, changed by one atomic rename per version, and keyed tables built on them.

A keyed table is a set of Parquet folders, one per bucket of its keys' hash, and a document that names them. A write
rewrites the buckets that its keys fall into, in new folders, and then publishes a document that names these in place of
the old ones. Until then nobody sees it: a write that stops half way leaves the table as it was. Versions are numbered,
and a name can be taken once: of two writers who began with the same version one wins, and the other one does its
change again on what it finds. Readers keep the version that they began with until it is vacuumed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import exists, list_names, read_bytes, remove, write_once

#: How often a writer does its change again when others come before it.
TRIES = 20


class ConflictError(Exception):
    """Another writer has taken the version."""


class Document:
    """The versions of a JSON document in a folder: files named by their numbers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in list_names(self.spark, self.folder) if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict | None]:
        """(version, content): the last one if None; (-1, None) before the first."""
        if version is None:
            version = max(self.versions(), default=-1)
        return version, json.loads(read_bytes(self.spark, self._path(version))) if version >= 0 else None

    def _path(self, version: int) -> str:
        return f"{self.folder}/{version:012d}.json"

    def publish(self, version: int, content: dict) -> None:
        """Takes a version; ConflictError if it is taken."""
        if not write_once(self.spark, self._path(version), json.dumps(content).encode()):
            raise ConflictError(f"version {version} of {self.folder} is taken")

    def change(self, f: Callable[[dict | None], dict]) -> dict:
        """Publishes f of the last content; again, with what is there then, if another writer came first."""
        for attempt in range(TRIES):
            version, content = self.read()
            made = f(content)
            try:
                self.publish(version + 1, made)
                return made
            except ConflictError:
                time.sleep(0.01 * attempt)
        raise ConflictError(f"{self.folder} changed {TRIES} times in a row")


class KeyedTable:
    """A table whose rows are changed by key. Keys may be null; a null is a value of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.document = Document(spark, f"{self.path}/versions")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 16) -> KeyedTable:
        """A new, empty table; ConflictError if there is one. buckets: some 100 MB of rows each, as many as the table will need."""
        table = cls(spark, path)
        table.document.publish(0, {"schema": schema.json(), "keys": keys, "buckets": buckets, "folders": {}, "what": "create"})
        return table

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        version, state = self.document.read(version)
        if state is None:
            raise FileNotFoundError(f"there is no table at {self.path}")
        return version, state

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        folders = [f"{self.path}/{f}" for b, f in state["folders"].items() if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if None. It stays as it is whatever is written meanwhile."""
        return self._rows(self._state(version)[1])

    def bucket_of(self, state: dict):
        return F.pmod(F.xxhash64(*state["keys"]), F.lit(state["buckets"])).cast("int")

    def _write(self, rows: DataFrame, state: dict) -> dict[str, str]:
        """Writes rows to new folders by bucket; bucket -> folder."""
        folder = f"data/{uuid.uuid4().hex}"
        names = StructType.fromJson(json.loads(state["schema"])).names
        placed = rows.select(*names).withColumn("_bucket", self.bucket_of(state))
        placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        made = [n for n in list_names(self.spark, f"{self.path}/{folder}") if n.startswith("_bucket=")]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in made}

    def _publish(self, build: Callable[[dict], dict], what: str) -> int:
        for attempt in range(TRIES):
            version, state = self._state()
            made = build(state)
            try:
                self.document.publish(version + 1, {**state, "folders": made, "what": what})
                return version + 1
            except ConflictError:
                time.sleep(0.01 * attempt)
        raise ConflictError(f"{self.path} changed {TRIES} times in a row")

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], what: str = "merge") -> int:
        """how(old rows, new rows) replaces the rows of the buckets that the keys of new fall into; the version it made.

        how must leave alone the rows whose keys new lacks, and is called again if another writer comes first.
        """

        def build(state):
            touched = [r["b"] for r in new.select(self.bucket_of(state).alias("b")).distinct().collect()]  # as many as buckets
            if not touched:
                return state["folders"]
            made = self._write(how(self._rows(state, touched), new), state)
            kept = {b: f for b, f in state["folders"].items() if int(b) not in set(touched)}
            return kept | made

        return self._publish(build, what)

    def delete(self, gone: DataFrame) -> int:
        """Without the rows that have the keys of gone."""
        keys = self._state()[1]["keys"]

        def without(old, new):
            same = None
            for k in keys:
                test = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
                same = test if same is None else same & test
            return old.alias("o").join(new.select(*keys).distinct().alias("n"), same, "left_anti")

        return self.merge(gone, without, "delete")

    def replace(self, rows: DataFrame) -> int:
        """All rows go, these come: in one version."""
        return self._publish(lambda state: self._write(rows, state), "replace")

    def history(self) -> list[dict]:
        return [{"version": n, "what": state["what"], "buckets": len(state["folders"])} for n, state in (self.document.read(k) for k in self.document.versions())]

    def vacuum(self, keep: int = 2) -> None:
        """Removes all versions but the last ones, and what only they or writes that stopped half way have. No write may be under way."""
        versions = self.document.versions()
        last = versions[-keep:]
        used = defaultdict(set)
        for n in last:
            for folder in self.document.read(n)[1]["folders"].values():
                top, _, bucket = folder.rpartition("/")
                used[top].add(bucket)
        for n in versions[:-keep]:
            remove(self.spark, self.document._path(n))
        if exists(self.spark, f"{self.path}/data"):
            for name in list_names(self.spark, f"{self.path}/data"):
                top = f"data/{name}"
                if top not in used:
                    remove(self.spark, f"{self.path}/{top}")
                    continue
                for bucket in list_names(self.spark, f"{self.path}/{top}"):
                    if bucket.startswith("_bucket=") and bucket not in used[top]:
                        remove(self.spark, f"{self.path}/{top}/{bucket}")

