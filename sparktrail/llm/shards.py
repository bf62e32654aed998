"""Operator 2: shards with size-tiered compaction and a versioned manifest, by DataFrame operations only.

A store is a folder: ``data/<run>/`` holds the immutable Parquet shards of a run, ``manifests/<version>.json`` says
which runs make up a version. ``append`` writes arrivals as small shards, one run each; ``compact`` merges runs of a
similar size: in the order of their sizes, runs of at most twice the mean size of those before (and all runs of less
than ``base`` bytes) make up a tier, and as soon as a tier has ``fanout`` runs, all of them become one run of files of
about ``target`` bytes. A row is so rewritten about once for each ``fanout``-fold growth of the store. A merge reads
the small files and writes each task's share as one file, without a shuffle, so it needs no memory for them and no key
can skew it. Nothing is changed in place: a version is committed by renaming a new manifest to the next number, which
the file system refuses if another writer was first (then the commit is tried again on top of that version). That needs
a store whose rename is atomic and does not overwrite, as HDFS and local ones; on an object store without, only one
writer may commit at a time. Readers of an older version keep their files until ``vacuum``. A lost executor only repeats
its tasks; a lost driver leaves a run that no manifest names, which ``vacuum`` removes.

The manifest names runs, not files: its size grows with the logarithm of the data. Each run has its own schema, and the
store that of all its runs: rows of runs that lack a column have null there, and a merge keeps every column. A column that
comes with another type, or in other case, is refused when it is appended. The store keeps nulls, repeated rows, and empty
and very long texts as they are. An empty arrival adds a run of no rows; a table without rows that is appended by arrival
adds its schema alone. A store that nothing was appended to reads as a table without columns.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrail.llm.common import filesystem, free_name, shared_path, table


def _both(first: dict | T.StructType, second: T.StructType | None) -> T.StructType:
    """The columns of the first schema, then those that only the second has; all may be null."""
    first = first if isinstance(first, T.StructType) else T.StructType.fromJson(first)
    kinds = {f.name: f.dataType for f in first.fields}
    cases = {f.name.lower(): f.name for f in first.fields}
    out = [T.StructField(f.name, f.dataType) for f in first.fields]
    for field in second.fields if second is not None else ():
        known = cases.get(field.name.lower())
        if known is None:
            out.append(T.StructField(field.name, field.dataType))
        elif known != field.name or kinds[known] != field.dataType:
            raise ValueError(f"column {field.name} {field.dataType.simpleString()} does not go with {known} {kinds[known].simpleString()}")
    return T.StructType(out)


class ShardStore:
    """Runs of shards under ``root``, a path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20, base: int = 1 << 20, fanout: int = 4):
        if fanout < 2 or target < 1 or base < 1:
            raise ValueError("fanout must be at least 2, target and base at least 1")
        self.spark, self.root, self.target, self.base, self.fanout = spark, root.rstrip("/"), target, base, fanout
        self.fs, _ = filesystem(spark, root)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The runs of a version, the latest by default; version 0 has none."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return {"version": 0, "schema": T.StructType([]).jsonValue(), "runs": []}
        stream = self.fs.open(self._path("manifests", f"{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, schema: T.StructType, added: list[dict], removed: set[str]) -> dict | None:
        """The next version: the latest without ``removed`` and with ``added``; None if a removed run is gone already."""
        while True:
            now = self.manifest()
            if not removed <= {r["run"] for r in now["runs"]}:
                return None
            new = {"version": now["version"] + 1, "schema": _both(now["schema"], schema).jsonValue(), "runs": [r for r in now["runs"] if r["run"] not in removed] + added}
            draft, final = self._path("manifests", f"{uuid.uuid4().hex}.draft"), self._path("manifests", f"{new['version']:012d}.json")
            out = self.fs.create(draft, False)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
            none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(final), none)
                return new
            except Exception:
                self.fs.delete(draft, False)
                if new["version"] not in self.versions():
                    raise

    def _described(self, run: str, schema: T.StructType) -> dict:
        return {"run": run, "bytes": self.fs.getContentSummary(self._path("data", run)).getLength(), "schema": schema.jsonValue()}

    def tiers(self, version: int | None = None) -> list[list[dict]]:
        """The runs of a version in groups of similar size, the smallest first."""
        out: list[list[dict]] = []
        for run in sorted(self.manifest(version)["runs"], key=lambda r: (r["bytes"], r["run"])):
            if out and (run["bytes"] < self.base or run["bytes"] * len(out[-1]) <= 2 * sum(r["bytes"] for r in out[-1])):
                out[-1].append(run)
            else:
                out.append([run])
        return out

    def append(self, rows: DataFrame) -> dict:
        """Write one arrival as a run of small shards and commit it."""
        run = uuid.uuid4().hex
        _both(self.manifest()["schema"], rows.schema)
        rows.write.parquet(f"{self.root}/data/{run}")
        return self._commit(rows.schema, [self._described(run, rows.schema)], set())

    def append_all(self, rows: DataFrame, arrival: str) -> list[dict]:
        """Append every arrival of ``rows`` (those equal in the column ``arrival``), written in one pass."""
        landing = uuid.uuid4().hex
        schema = rows.drop(arrival).schema
        _both(self.manifest()["schema"], schema)
        rows.write.partitionBy(arrival).parquet(f"{self.root}/data/{landing}")
        done = []
        for found in sorted(self.fs.listStatus(self._path("data", landing)), key=lambda f: f.getPath().getName()):
            if found.isDirectory():
                run = f"{landing}/{found.getPath().getName()}"
                done.append(self._commit(schema, [self._described(run, schema)], set()))
        return done or [self._commit(schema, [], set())]

    def compact(self) -> list[dict]:
        """Merge full tiers until no tier has ``fanout`` runs; the versions committed."""
        done = []
        while full := [tier for tier in self.tiers() if len(tier) >= self.fanout]:
            merged = self._merge(full[0])
            if merged is not None:
                done.append(merged)
        return done

    def _merge(self, runs: list[dict]) -> dict | None:
        run, size = uuid.uuid4().hex, sum(r["bytes"] for r in runs)
        rows = self._rows(runs)
        rows.coalesce(max(1, math.ceil(size / self.target))).write.parquet(f"{self.root}/data/{run}")
        return self._commit(rows.schema, [self._described(run, rows.schema)], {r["run"] for r in runs})

    def _rows(self, runs: list[dict], schema: T.StructType | None = None) -> DataFrame:
        """The rows of some runs, with the columns of all of them (or those of ``schema``)."""
        for run in runs if schema is None else ():
            schema = _both(run["schema"], schema)
        if not runs:
            return self.spark.createDataFrame([], schema or T.StructType([]))
        # a column that a run's files lack reads as null
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{r['run']}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        known = self.manifest(version)
        return self._rows(known["runs"], T.StructType.fromJson(known["schema"]))

    def files(self, version: int | None = None) -> DataFrame:
        """(file, bytes, n_rows) of the shards of a version that hold rows."""
        named = self.read(version).select("_metadata.file_path", "_metadata.file_size")
        return named.groupBy(F.col("file_path").alias("file"), F.col("file_size").alias("bytes")).agg(F.count("*").alias("n_rows"))

    def vacuum(self, keep: int = 1) -> None:
        """Remove manifests but the last ``keep`` ones and all runs that none of these names; no writer may be at work."""
        known = self.versions()
        kept = known[-keep:] if keep else []
        named = {r["run"] for v in kept for r in self.manifest(v)["runs"]}
        for version in known[: len(known) - len(kept)]:
            self.fs.delete(self._path("manifests", f"{version:012d}.json"), False)
        for top in self.fs.listStatus(self._path("data")):
            name = top.getPath().getName()
            inside = [n for n in named if n == name or n.startswith(f"{name}/")]
            if not inside:
                self.fs.delete(top.getPath(), True)
            elif name not in named:
                for part in self.fs.listStatus(top.getPath()):
                    if f"{name}/{part.getPath().getName()}" not in named:
                        self.fs.delete(part.getPath(), True)


def op2_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a store: 8 arrivals appended, compacted and read at the version reached."""
    docs = table(spark, sf_dir, "documents")
    arrival = free_name(docs, "arrival")
    store = ShardStore(spark, shared_path(spark, "shards"), fanout=8)
    store.append_all(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(8))), arrival)
    store.compact()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text"), 256).alias("text_sha256"))


OP2_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
