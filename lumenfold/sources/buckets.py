"""An index of documents in hash buckets, updated by the touched buckets only and committed at once.

Documents are dealt to a fixed number of buckets by a hash of their id. A bucket has a state (document_id, content_hash, units)
and the units themselves. A version of the index is a manifest: one small JSON file that names, for every table and bucket,
the folder that holds it. An update reads the buckets its documents fall into, writes those anew in a folder of its own, and
then commits by renaming the next manifest into place, units and state together. Readers hold a manifest and see one version
throughout; an update that breaks off leaves files that no manifest names, and two updates that start from the same
version cannot both commit. `vacuum` deletes what no kept version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import content_hash
from lumenfold.operators import incremental
from lumenfold.operators.chunking import token_chunks
from lumenfold.storage import materialise

TABLES = ("state", "units")
#: One entry of a manifest for each table and bucket, about 100 bytes each.
MOST_BUCKETS = 16_384


class Conflict(RuntimeError):
    """Another update was committed since this one began."""


def chunks_of(documents: DataFrame) -> DataFrame:
    """(id, document_id, text): the units of documents (document_id, text)."""
    return token_chunks(documents, key="document_id").select(F.col("chunk_id").alias("id"), "document_id", F.col("chunk").alias("text"))


class BucketedIndex:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 256, units_of: Callable[[DataFrame], DataFrame] = chunks_of) -> None:
        if not 0 < buckets <= MOST_BUCKETS:
            raise ValueError(f"{buckets} buckets; 1 to {MOST_BUCKETS} are possible")
        self.spark, self.root, self.buckets, self.units_of = spark, root.rstrip("/"), buckets, units_of

    # Files through Hadoop, so that any store that Spark writes to will do.

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names(f"{self.root}/manifests") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, buckets, batches, tables: {table: {bucket: folder}}}"""
        have = self.versions()
        if version is None and not have:
            return {"version": 0, "buckets": self.buckets, "batches": {}, "tables": {t: {} for t in TABLES}}
        fs, at = self._fs(f"{self.root}/manifests/v{have[-1] if version is None else version}.json")
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        if found["buckets"] != self.buckets:
            raise ValueError(f"the index has {found['buckets']} buckets, not {self.buckets}")
        return found

    def _commit(self, manifest: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        fs, draft = self._fs(f"{self.root}/drafts/{uuid.uuid4().hex}.json")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        _, target = self._fs(f"{self.root}/manifests/v{manifest['version']}.json")
        fs.mkdirs(target.getParent())
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, options)
        except Exception as problem:
            if "FileAlreadyExistsException" in str(problem):
                raise Conflict(f"version {manifest['version']} was committed by another update") from problem
            raise

    def bucket(self, name: str = "document_id"):
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def read(self, table: str, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """A table of one version, or those of its buckets; None if there is nothing yet."""
        manifest = manifest or self.manifest()
        held = manifest["tables"][table]
        folders = [f"{self.root}/{held[str(b)]}" for b in (range(self.buckets) if buckets is None else buckets) if str(b) in held]
        return self.spark.read.schema(manifest["schemas"][table]).parquet(*folders) if folders else None

    def lookup(self, table: str, ids: list) -> DataFrame | None:
        """Rows of few documents, from their buckets only."""
        kind = self.manifest().get("schemas", {}).get(table, "document_id string").split(",")[0].split(" ")[-1]
        wanted = self.spark.createDataFrame([(i,) for i in ids], f"document_id {kind.lower()}")
        rows = self.read(table, sorted({r[0] for r in wanted.select(self.bucket()).collect()}))
        return rows if rows is None else rows.join(F.broadcast(wanted), "document_id", "left_semi")  # as many rows as ids were given

    def update(self, arrived: DataFrame, order: str = "version", deleted: DataFrame | None = None, batch: tuple[str, int] | None = None) -> list[int]:
        """Take documents (document_id, text, and the column `order`) in, and leave out `deleted` (document_id); returns the
        buckets that were written. Of a document's rows that of the largest `order` counts, among equal ones the largest text.
        Rows with a null document_id or text are passed over. Unchanged documents touch no bucket. A `batch` (stream, number)
        that was committed before is not taken again. (R7, I4, I5)"""
        manifest = self.manifest()
        if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return []
        rows = arrived.where("document_id IS NOT NULL AND text IS NOT NULL").groupBy("document_id").agg(F.max_by("text", F.struct(order, "text")).alias("text"))
        rows = materialise(rows.withColumn("bucket", self.bucket()))
        new = materialise(rows.select("document_id", content_hash(F.col("text")).alias("content_hash"), "bucket"))
        gone = None if deleted is None else materialise(deleted.select("document_id").distinct().withColumn("bucket", self.bucket()))
        asked = new.select("bucket") if gone is None else new.select("bucket").union(gone.select("bucket"))
        near = sorted(r[0] for r in asked.distinct().collect())  # at most `buckets`
        state, units = (self.read(t, near, manifest) for t in TABLES)
        changed, dropped = new, None
        if state is not None:
            changed = new.join(state.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")
            dropped = None if gone is None else gone.join(state.select("document_id"), "document_id", "left_semi")
        touched = materialise(changed.select("document_id", "bucket").unionByName(dropped) if dropped is not None else changed.select("document_id", "bucket"))
        write = sorted(r[0] for r in touched.select("bucket").distinct().collect())
        if write:
            made = self.units_of(rows.join(changed.select("document_id"), "document_id", "left_semi").select("document_id", "text")).withColumn("bucket", self.bucket())
            made = materialise(made)
            names = made.groupBy("document_id").agg(F.array_sort(F.collect_list("id")).alias("units"))
            none = F.array().cast("array<string>")
            stated = changed.join(names, "document_id", "left").select("document_id", "content_hash", F.coalesce("units", none).alias("units"), "bucket")
            if gone is not None:
                stated, made = (x.join(gone.select("document_id"), "document_id", "left_anti") for x in (stated, made))
            folder = f"data/{uuid.uuid4().hex}"
            fresh = {"state": stated, "units": made}
            for table, old in (("state", state), ("units", units)):
                kept = fresh[table]
                if old is not None:
                    old = self.read(table, write, manifest)
                    kept = old.withColumn("bucket", self.bucket()).join(touched.select("document_id"), "document_id", "left_anti").unionByName(kept) if old is not None else kept
                kept.repartition(min(len(write), self.buckets), "bucket").sortWithinPartitions("bucket", "document_id").write.partitionBy("bucket").parquet(f"{self.root}/{folder}/{table}")
                manifest.setdefault("schemas", {})[table] = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.drop("bucket").schema)
                there = set(self._names(f"{self.root}/{folder}/{table}"))
                for b in write:  # a bucket may have become empty
                    if f"bucket={b}" in there:
                        manifest["tables"][table][str(b)] = f"{folder}/{table}/bucket={b}"
                    else:
                        manifest["tables"][table].pop(str(b), None)
        if write or batch:
            manifest["version"] += 1
            if batch:
                manifest["batches"][batch[0]] = batch[1]
            self._commit(manifest)
        return write

    def strategy(self, arrived: DataFrame, deleted: DataFrame | None = None) -> str:
        """What an update would do: build an empty index, replace documents in their buckets, or nothing."""
        state = self.read("state")
        if state is None:
            return "none" if arrived.isEmpty() else "rebuild"
        new = arrived.select("document_id", content_hash(F.col("text")).alias("content_hash"), F.lit(None).cast("array<string>").alias("units"))
        moved = incremental.classify(state, new, check_deleted=False).where("change_type <> 'UNCHANGED'")
        lost = deleted is not None and not deleted.join(state, "document_id", "left_semi").isEmpty()
        return "replace" if lost or not moved.isEmpty() else "none"

    def vacuum(self, keep: int = 1) -> int:
        """Delete the buckets that none of the last `keep` versions names, and older manifests; how many buckets went."""
        have = self.versions()
        named = {f for v in have[-keep:] for t in self.manifest(v)["tables"].values() for f in t.values()}
        written = [f"data/{n}/{t}/{b}" for n in self._names(f"{self.root}/data") for t in TABLES for b in self._names(f"{self.root}/data/{n}/{t}") if b.startswith("bucket=")]
        lost = [f for f in written if f not in named]
        for path in [*(f"{self.root}/{f}" for f in lost), *(f"{self.root}/manifests/v{v}.json" for v in have[:-keep]), f"{self.root}/drafts"]:
            fs, at = self._fs(path)
            fs.delete(at, True)
        return len(lost)
