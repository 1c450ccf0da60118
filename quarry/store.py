"""The stored tables: Parquet folders under one root, and manifests that say which of them are current."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, types as T

from .operators.fulltext import arranged
from .schema import SCHEMA_VERSION, TABLES

#: Versions a part may consist of before append() writes it anew.
MOST_VERSIONS = 16
#: Seconds that a folder no manifest names is kept for readers that began before it was replaced.
GRACE_S = 3600


class Store:
    """Tables by name, in parts: a part is what one repository holds of a table, or "" for what belongs to none.

    A commit writes new folders and then one manifest, which switches all tables it touches at once; readers see all of
    a commit or nothing, and a run that breaks off leaves the state before it. A manifest is complete when it parses and
    says so, so a half-written one is passed over. Two commits at once: the second fails, as manifest numbers are taken
    by creating the file. Old folders stay until vacuum(), so running readers keep theirs.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._migrate()

    # files

    def _path(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def _read(self, path: str) -> str | None:
        p, fs = self._path(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _list(self, path: str) -> list:
        p, fs = self._path(path)
        return list(fs.listStatus(p)) if fs.exists(p) else []

    # manifests

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._list(f"{self.root}/_manifest")]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0] != ".")

    def _manifest(self) -> dict:
        for number in reversed(self._numbers()):
            try:
                found = json.loads(self._read(f"{self.root}/_manifest/{number:012d}.json") or "")
            except ValueError:
                continue
            if found.get("complete"):
                return found
        return {"schema": SCHEMA_VERSION, "tables": {}, "meta": {}, "complete": True}

    def _put(self, manifest: dict, number: int) -> None:
        p, fs = self._path(f"{self.root}/_manifest/{number:012d}.json")
        stream = fs.create(p, False)  # fails if another commit took the number
        try:
            stream.write(bytearray(json.dumps(manifest | {"complete": True}).encode()))
        finally:
            stream.close()

    def _migrate(self) -> None:
        """Brings a store of an older layout to this one; one of a newer layout is refused.

        Layout 1 had one folder a table, named by a pointer file; its tables are copied as parts.
        """
        manifest = self._manifest()
        if manifest["schema"] > SCHEMA_VERSION:
            raise ValueError(f"the store has layout {manifest['schema']}, newer than {SCHEMA_VERSION}")
        if self._numbers():
            return
        old = {name: pointer.strip() for name in TABLES if (pointer := self._read(f"{self.root}/{name}/_current"))}
        changes: dict[tuple[str, str], DataFrame] = {}
        for name, version in old.items():
            rows = self.spark.read.parquet(f"{self.root}/{name}/{version}")
            if name == "dependencies" and "symbols" in old:  # an edge belongs where its caller does
                owners = self.spark.read.parquet(f"{self.root}/symbols/{old['symbols']}").selectExpr("id as caller_id", "repo_name")
                rows = rows.join(owners.distinct(), "caller_id")
            if "repo_name" in rows.columns:
                for r in rows.select("repo_name").distinct().collect():  # one row a repository
                    changes[name, r.repo_name or ""] = rows.where(rows.repo_name.eqNullSafe(r.repo_name))
            else:
                changes[name, ""] = rows
        if changes:
            self.commit(changes)

    # reading

    def exists(self, name: str, part: str | None = None) -> bool:
        parts = self._manifest()["tables"].get(name, {})
        return bool(parts) if part is None else part in parts

    def parts(self, name: str) -> list[str]:
        return sorted(self._manifest()["tables"].get(name, {}))

    def version(self, name: str, part: str) -> str:
        """Names the state of a part; another state has another name."""
        return ",".join(self._manifest()["tables"].get(name, {}).get(part, []))

    def meta(self, key: str, default=None):
        return self._manifest()["meta"].get(key, default)

    def read(self, name: str, part: str | None = None) -> DataFrame:
        """The current rows of a table, or of one part of it; an empty table of the model's schema if there are none."""
        held = self._manifest()["tables"].get(name, {})
        folders = [f"{self.root}/{name}/part={_key(p)}/version={v}" for p, versions in held.items() if part is None or p == part for v in versions]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        names = TABLES[name].fieldNames()
        schema = T.StructType([*TABLES[name].fields, T.StructField("part", T.StringType()), T.StructField("version", T.StringType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*folders).select(*names)

    # writing

    def commit(self, changes: dict[tuple[str, str], DataFrame | None], meta: dict | None = None, append: bool = False) -> None:
        """{(table, part): rows} replace those parts in one step; None drops a part. append adds the rows instead."""
        manifest = self._manifest()
        tables = {n: dict(parts) for n, parts in manifest["tables"].items()}
        todo: dict[tuple[str, str], DataFrame] = {}
        for (name, part), rows in changes.items():
            held = tables.setdefault(name, {})
            if rows is None:
                held.pop(part, None)
                continue
            before = held.get(part, []) if append else []
            if len(before) >= MOST_VERSIONS:
                rows, before = self.read(name, part).unionByName(rows.select(*TABLES[name].fieldNames())), []
            held[part], todo[name, part] = [*before], rows
        for (name, part), version in self._written(todo).items():
            tables[name][part].append(version)
        numbers = self._numbers()
        self._put({"schema": SCHEMA_VERSION, "tables": tables, "meta": manifest["meta"] | (meta or {}), "at": time.time()}, numbers[-1] + 1 if numbers else 1)

    def _written(self, todo: dict[tuple[str, str], DataFrame]) -> dict[tuple[str, str], str]:
        """Writes all parts at the same time, so small ones do not wait for each other; their versions."""
        done: dict[tuple[str, str], str] = {}
        failed: list[BaseException] = []

        def write(name: str, part: str, rows: DataFrame) -> None:
            try:
                done[name, part] = self._write(name, part, rows)
            except BaseException as e:  # noqa: BLE001 - raised below, in the caller's thread
                failed.append(e)

        threads = [InheritableThread(target=write, args=(*key, rows)) for key, rows in todo.items()]  # a job's tags go along
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        if failed:
            raise failed[0]
        return done

    def _write(self, name: str, part: str, rows: DataFrame) -> str:
        version = uuid.uuid4().hex[:12]
        ordered = rows.select(*TABLES[name].fieldNames())
        if name == "fts_postings":
            ordered = arranged(ordered)
        writer = ordered.write.option("compression", "zstd")
        writer.parquet(f"{self.root}/{name}/part={_key(part)}/version={version}")
        return version

    def write(self, name: str, rows: DataFrame, part: str = "") -> None:
        """rows become the part; they may be computed from its current rows, which stay on disk until vacuum()."""
        self.commit({(name, part): rows})

    def append(self, name: str, rows: DataFrame, part: str = "") -> None:
        self.commit({(name, part): rows}, append=True)

    def vacuum(self, grace_s: int = GRACE_S) -> int:
        """Deletes the folders that no current part names and that are older than the grace; how many."""
        manifest, limit, gone = self._manifest(), (time.time() - grace_s) * 1000, 0
        for name in TABLES:
            held = {_key(p): set(v) for p, v in manifest["tables"].get(name, {}).items()}
            for folder in self._list(f"{self.root}/{name}"):
                part = folder.getPath().getName().removeprefix("part=")
                for s in self._list(folder.getPath().toString()):
                    if s.getPath().getName().removeprefix("version=") not in held.get(part, ()) and s.getModificationTime() <= limit:
                        self._path(s.getPath().toString())[1].delete(s.getPath(), True)
                        gone += 1
        for number in self._numbers()[:-2]:
            p, fs = self._path(f"{self.root}/_manifest/{number:012d}.json")
            if fs.getFileStatus(p).getModificationTime() <= limit:
                fs.delete(p, False)
        return gone


def _key(part: str) -> str:
    return hashlib.sha256(part.encode()).hexdigest()[:16]
