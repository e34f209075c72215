"""Places and scopes: lines in ranges, the last definition before a use, files' roles, receivers, bands and moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def containing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points (file, line) with each range (file, id, sl, el) that holds them, both ends included.

    A range belongs to the grid whose cells are as long as the next power of two, of which it touches two at most; a
    point looks into its cell of every grid in use. So it is an equi-join whose matches are near hits, whatever a
    file's size; ranges that end before they start hold nothing.
    """
    placed = ranges.where("el >= sl").withColumn("_level", F.length(F.bin(F.col("el") - F.col("sl"))).cast("int"))
    cell = lambda line: F.expr(f"shiftright({line}, _level)")
    placed = placed.withColumn("_cell", F.explode(F.array_distinct(F.array(cell("sl"), cell("el")))))
    # At most 64 numbers.
    grids = sorted(r[0] for r in placed.select("_level").distinct().collect())
    looked = points.withColumn("_level", F.explode(F.lit(grids).cast("array<int>"))).withColumn("_cell", cell("line"))
    return looked.join(placed, ["file", "_level", "_cell"]).where("line between sl and el").drop("_level", "_cell")


def node_at(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, line, id, n_enclosing): the innermost range around each point: the shortest, of those the latest, then the smallest id."""
    best = F.min(F.struct((F.col("el") - F.col("sl")).alias("size"), (-F.col("sl")).alias("late"), "id"))
    return containing(points.distinct(), ranges).groupBy("file", "line").agg(best.alias("b"), F.count("*").alias("n_enclosing")).select("file", "line", "b.id", "n_enclosing")


def last_before(rows: DataFrame, by: str, part: Column, order: list[str], value: Column) -> DataFrame:
    """rows with `last`: the latest non-null value of an earlier row of the same `by`.

    `part` must rise with the order. Rows are ordered within parts only, and one row a part carries the last value on,
    so a `by` that holds a large share of all rows is many tasks' work. Rows without `by` stay, with no last value.
    """
    rows = rows.withColumn("_part", part).withColumn("_value", value)
    inside = Window.partitionBy(by, "_part").orderBy(*order)
    ends = rows.where("_value is not null").groupBy(by, "_part").agg(F.max_by("_value", F.struct(*order)).alias("_end"))
    ends = rows.select(by, "_part").distinct().join(ends, [by, "_part"], "left")
    over = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(by, "_part", F.last("_end", ignorenulls=True).over(over).alias("_carried"))
    here = F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_here", here).join(carried, [by, "_part"], "left").withColumn("last", F.when(F.col(by).isNotNull(), F.coalesce("_here", "_carried"))).drop("_part", "_value", "_here", "_carried")


def file_roles(files: DataFrame, imports: DataFrame, refs: DataFrame) -> DataFrame:
    """(file, role) of files (file, entry, effects) by imports (src, dst, sideeffect) and references between files (src, dst)."""
    into = imports.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("n_in"), F.count(F.when(~F.col("sideeffect"), 1)).alias("n_value"))
    used = refs.where("src <> dst").select(F.col("dst").alias("file"), F.lit(True).alias("used")).distinct()
    d = files.join(into, "file", "left").join(used, "file", "left").fillna(0, ["n_in", "n_value"])
    lone = F.col("n_in") == 0
    role = F.when(lone & F.col("entry"), "entry").when(F.col("used"), "used").when(lone, "orphan").when(F.col("n_value") > 0, "value").when(F.col("effects"), "sideeffect").otherwise("deadimport")
    return d.select("file", role.alias("role"))


def narrowable(calls: DataFrame, imports: DataFrame, names: DataFrame) -> DataFrame:
    """(file, recv, class, n_calls, score) of ambiguous calls (fn, file, name) by what their receiver is.

    Self weighs 3, a name that the file imports (file, name) 4, a parameter or local of the function (fn, name) 2, else 1.
    """
    recv = F.regexp_extract("name", r"^([^.:]+)[.:]", 1)
    d = calls.withColumn("recv", recv).where("recv <> ''")
    d = d.join(imports.select("file", F.col("name").alias("recv"), F.lit(True).alias("_alias")).distinct(), ["file", "recv"], "left")
    d = d.join(names.select("fn", F.col("name").alias("recv"), F.lit(True).alias("_local")).distinct(), ["fn", "recv"], "left")
    kind = F.when(F.col("recv").isin("self", "this"), "self").when(F.col("_alias"), "alias").when(F.col("_local"), "local").otherwise("unknown")
    weight = F.when(F.col("class") == "alias", 4).when(F.col("class") == "self", 3).when(F.col("class") == "local", 2).otherwise(1)
    per = d.groupBy("file", "recv", kind.alias("class")).agg(F.count("*").alias("n_calls"))
    return per.withColumn("score", F.col("n_calls") * weight)


def link_bands(ports: DataFrame, exports: DataFrame, shares: DataFrame) -> DataFrame:
    """(band, name, n_hits, outcome) of open names (band, name) in peers (peer, name) that the band shares with (band, peer): one hit links, several stay open."""
    hits = shares.distinct().join(exports.distinct(), "peer").groupBy("band", "name").agg(F.count("*").alias("n_hits"))
    d = ports.select("band", "name").distinct().join(hits, ["band", "name"], "left").fillna(0, ["n_hits"])
    return d.withColumn("outcome", F.when(F.col("n_hits") == 1, "linked").when(F.col("n_hits") > 1, "ambiguous").otherwise("missing"))


def move_hazards(moves: DataFrame, needs: DataFrame, imports: DataFrame, effects: DataFrame) -> DataFrame:
    """(id, hazards) of symbols to be moved (id, file, dest): noop, load-order (either file acts on loading), cycle (a file it needs imports dest)."""
    acts = effects.select("file").distinct().withColumn("_acts", F.lit(True))
    back = needs.join(imports, F.col("need") == F.col("src")).select("id", F.col("dst").alias("dest")).distinct().withColumn("_cycle", F.lit(True))
    d = moves.join(acts, "file", "left").withColumnRenamed("_acts", "_here").join(acts.withColumnRenamed("file", "dest"), "dest", "left").join(back, ["id", "dest"], "left")
    noop = F.col("file") == F.col("dest")
    each = [F.when(noop, "noop"), F.when(F.coalesce("_here", "_acts"), "load-order"), F.when(F.col("_cycle"), "cycle")]
    return d.select("id", F.concat_ws(",", *each).alias("hazards"))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that several rows have, and how many: a primary key has none."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
