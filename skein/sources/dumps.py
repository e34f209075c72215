"""Graph dumps in JSON, shards by file, and what of them is read again after files changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.graph import Graph

NODE = "id string, name string, kind string, file string, line long, entry string"
EDGE = "src string, dst string, kind string, n long, tier string, rw int"
CALL = "fn string, callee string, file string, line long, target string, rule string"
#: A dump is one document of this schema, or many, one a line; a graph is the union of all its documents.
DUMP = f"nodes array<struct<{NODE}>>, edges array<struct<{EDGE}>>, calls array<struct<{CALL}>>"


def dump_lines(graph: Graph) -> DataFrame:
    """(value): the graph with one record a line, each a document of its own, so that readers may split it anywhere."""
    parts = []
    for (name, ddl), rows in zip(PARTS.items(), (graph.nodes, graph.edges, graph.calls)):
        record = F.struct(*[F.col(c.split()[0]) for c in ddl.split(", ")])
        parts.append(rows.select(F.to_json(F.struct(F.array(record).alias(name))).alias("value")))
    return parts[0].union(parts[1]).union(parts[2])


PARTS = {"nodes": NODE, "edges": EDGE, "calls": CALL}


def _parsed(documents: DataFrame) -> Graph:
    return Graph(*[documents.select(F.inline(name)) for name in PARTS])


def from_lines(lines: DataFrame) -> Graph:
    """The graph of (value) lines; a line that isn't JSON raises, a missing part is empty. A part's values are read, and raise, with that part.

    There is no filter on lines, and the outer explode makes none on parsed parts, for which Spark would make or parse a line once more or twice.
    """
    full = F.when(F.trim("value") != "", F.col("value"))
    parts = []
    for name, ddl in PARTS.items():
        rows = lines.select(F.from_json(full, f"{name} array<struct<{ddl}>>", {"mode": "FAILFAST"}).alias("d")).select(F.posexplode_outer(f"d.{name}").alias("_at", "_row"))
        parts.append(rows.where("_at is not null").select("_row.*"))
    return Graph(*parts)


def read_dump(spark: SparkSession, path: str, document: bool = False) -> Graph:
    """The graph of a dump's files: a document a line, or with `document` one a file, which a single task has to read."""
    return _parsed(spark.read.schema(DUMP).json(path, multiLine=document, mode="FAILFAST"))


def write_dump(graph: Graph, path: str) -> None:
    dump_lines(graph).write.mode("errorifexists").text(path)


def shard_sizes(graph: Graph) -> DataFrame:
    """(file, n_nodes, n_edges, n_cross, n_calls): the rows that each file's shard holds.

    An edge belongs to the file of its source; n_cross counts those that end in another file or nowhere. Edges from unknown nodes are in the shard of file null.
    """
    home = graph.nodes.select("id", "file")
    ends = graph.edges.join(home.toDF("src", "file"), "src", "left").join(home.toDF("dst", "to"), "dst", "left")
    cross = F.count(F.when(~F.col("file").eqNullSafe(F.col("to")), 1))
    zero = F.lit(0).cast("long")
    rows = graph.nodes.groupBy("file").agg(F.count("*").alias("n_nodes")).select("file", "n_nodes", zero.alias("n_edges"), zero.alias("n_cross"), zero.alias("n_calls"))
    rows = rows.union(ends.groupBy("file").agg(F.count("*").alias("n"), cross.alias("x")).select("file", zero, "n", "x", zero))
    rows = rows.union(graph.calls.groupBy("file").agg(F.count("*").alias("n")).select("file", zero, zero, zero, "n"))
    return rows.groupBy("file").agg(*[F.sum(c).alias(c) for c in rows.columns[1:]])


def stamp_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change) of stamps (file, stamp): added, deleted, changed or same. A null stamp is unknown and so changed; of repeated files the largest stamp counts."""
    was, now = (s.groupBy("file").agg(F.max("stamp").alias(name), F.lit(True).alias(f"in_{name}")) for s, name in ((old, "was"), (new, "now")))
    change = F.when(F.col("in_was").isNull(), "added").when(F.col("in_now").isNull(), "deleted").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return was.join(now, "file", "full").select("file", change.alias("change"))


def warm_open(shards: DataFrame, fresh: DataFrame, diff: DataFrame) -> DataFrame:
    """Rows with a file, and `origin`: of files that are the same from the shards, of changed and added ones from fresh, of deleted ones none."""
    kept = shards.join(diff.where("change = 'same'").select("file"), "file", "semi").withColumn("origin", F.lit("shard"))
    read = fresh.join(diff.where("change in ('changed', 'added')").select("file"), "file", "semi").withColumn("origin", F.lit("read"))
    return kept.unionByName(read)


def garbage(shards: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file): shards that the manifest doesn't name."""
    return shards.select("file").distinct().join(manifest.select("file"), "file", "anti")
