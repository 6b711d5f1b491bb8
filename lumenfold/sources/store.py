"""The Parquet store of an index: documents, units, embeddings and the layers built on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.routing import buildable

#: Tables of each level.
LEVELS = {
    0: ("documents", "text_units", "embeddings"),
    1: ("nlp_features", "noun_phrase_nodes", "noun_phrase_edges", "communities_l1"),
    2: ("entities", "relationships"),
    3: ("community_reports",),
    4: ("claims",),
}
#: Ids up to this number become a pushed-down IN list; more are a semi join.
FEW_IDS = 200


class Store:
    """Tables under a folder, one directory a level. Each save goes to a new version directory, so that a table can be
    rewritten from itself and readers keep what they read."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        level = next((k for k, names in LEVELS.items() if name in names), None)
        return f"{self.root}/level_{level}/{name}" if level is not None else f"{self.root}/other/{name}"

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def versions(self, name: str) -> list[int]:
        fs, at = self._fs(self.path(name))
        if not fs.exists(at):
            return []
        found = []
        for s in fs.listStatus(at):
            v = s.getPath().getName()
            if v.startswith("v") and fs.exists(self._fs(f"{self.path(name)}/{v}/_SUCCESS")[1]):
                found.append(int(v[1:]))
        return sorted(found)

    def write(self, name: str, rows: DataFrame, append: bool = False) -> None:
        """Replace a table, or append files to its current version."""
        have = self.versions(name)
        if append and have:
            rows.write.mode("append").parquet(f"{self.path(name)}/v{have[-1]}")
        else:
            rows.write.parquet(f"{self.path(name)}/v{(have or [0])[-1] + 1}")

    def read(self, name: str, columns: Iterable[str] | None = None, where: str | None = None) -> DataFrame | None:
        """Columns and filter reach the Parquet scan; None for a table that is not there."""
        have = self.versions(name)
        if not have:
            return None
        rows = self.spark.read.parquet(f"{self.path(name)}/v{have[-1]}")
        if where:
            rows = rows.where(where)
        return rows.select(*columns) if columns else rows

    def by_ids(self, name: str, ids, key: str = "id") -> DataFrame:
        """Rows by key: a pushed-down list for few ids, a semi join with a DataFrame or many."""
        rows = self.read(name)
        if isinstance(ids, DataFrame):
            return rows.join(ids.select(key), key, "left_semi")
        ids = list(ids)
        if len(ids) <= FEW_IDS:
            return rows.where(F.col(key).isin(ids))
        return rows.join(self.spark.createDataFrame([(i,) for i in ids], f"{key} {rows.schema[key].dataType.simpleString()}"), key, "left_semi")

    def embeddings(self, vectors: bool = True) -> DataFrame:
        """(S20)"""
        rows = self.read("embeddings")
        return rows if vectors else rows.drop("vector")

    def delete(self, name: str, ids: DataFrame, key: str = "id") -> None:
        """Rewrite without the ids."""
        self.write(name, self.read(name).join(ids.select(key), key, "left_anti"))

    def clear(self, name: str) -> None:
        """An empty version of the table."""
        self.write(name, self.read(name).limit(0))

    def count(self, name: str) -> int:
        return self.read(name).count()

    def stats(self) -> DataFrame:
        """(name, n_rows, n_bytes) of every table."""
        out = self.spark.createDataFrame([], "name string, n_rows long, n_bytes long")
        for names in LEVELS.values():
            for name in names:
                rows = self.read(name)
                if rows is not None:
                    files = rows.groupBy("_metadata.file_path").agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("b"))
                    out = out.unionByName(files.agg(F.lit(name).alias("name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes")))
        return out

    def built(self) -> list[int]:
        """Levels whose tables are all there."""
        return [k for k, names in LEVELS.items() if all(self.versions(n) for n in names)]

    def build(self, builders: dict, target: int, force: bool = False) -> list[int]:
        """Run the builders of the levels that are missing up to `target`, in order; a builder gives {name: DataFrame}."""
        todo = buildable(self.built(), target, force)
        for level in todo:
            for name, rows in builders[level](self).items():
                self.write(name, rows)
        return todo


def export_graph(edges: DataFrame, nodes: DataFrame, folder: str) -> None:
    """Edges as CSV with a header, nodes as JSON lines."""
    edges.write.option("header", True).csv(f"{folder}/edges_csv")
    nodes.write.json(f"{folder}/nodes_json")


def graphml(edges: DataFrame) -> DataFrame:
    """(line) of a GraphML file: header, edges, end; write it with `.coalesce` or read the parts in order."""
    spark = edges.sparkSession
    escape = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    head = spark.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (2, "</graph></graphml>")], "part int, line string")
    rows = edges.select(F.lit(1).alias("part"), F.concat(F.lit('<edge source="'), escape("src"), F.lit('" target="'), escape("dst"), F.lit('"/>')).alias("line"))
    return head.unionByName(rows).orderBy("part", "line").select("line")


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a GraphML text."""
    lines = spark.read.text(path)
    pattern = r'<edge[^>]*source="([^"]*)"[^>]*target="([^"]*)"'
    return lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("src"), F.regexp_extract("value", pattern, 2).alias("dst"))


def export_documents(docs: DataFrame, folder: str, kind: str = "csv") -> None:
    """(S25)"""
    writer = docs.write.option("header", True)
    writer.csv(folder) if kind == "csv" else docs.write.json(folder)
