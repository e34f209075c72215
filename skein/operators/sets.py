"""Comparisons of sets, partitions and layered values, rankings, and small analyses over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, added and removed: rows (key, outcome, n) of two keyed censuses whose count differs, by outcome."""
    on = [*key, "outcome"]
    j = before.withColumnRenamed("n", "b").join(after.withColumnRenamed("n", "a"), on, "full").fillna(0, ["a", "b"])
    return j.where("a <> b").select(*on, F.col("b").alias("n_before"), F.col("a").alias("n_after"))


def set_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, outcome): of each file whether its set of names (file, name) changed; a file on one side alone isn't compared."""
    side = lambda df, c: df.distinct().groupBy("file").agg(F.count("*").alias(f"n_{c}"), F.bit_xor(F.xxhash64("name")).alias(f"x_{c}"), F.sum(F.xxhash64("name").cast("decimal(38,0)")).alias(f"s_{c}"))
    j = side(before, "b").join(side(after, "a"), "file", "full")
    same = (F.col("n_a") == F.col("n_b")) & (F.col("x_a") == F.col("x_b")) & (F.col("s_a") == F.col("s_b"))
    return j.select("file", F.when(F.col("n_a").isNull() | F.col("n_b").isNull(), "not compared").when(same, "same").otherwise("changed").alias("outcome"))


def structural_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, kind, added, removed, renamed) of symbols (file, kind, name): a bucket with just one of each is a rename."""
    b, a = before.select("file", "kind", "name").distinct(), after.select("file", "kind", "name").distinct()
    j = b.withColumn("b", F.lit(1)).join(a.withColumn("a", F.lit(1)), ["file", "kind", "name"], "full").fillna(0, ["a", "b"])
    per = j.where("a <> b").groupBy("file", "kind").agg(F.sum("a").alias("added"), F.sum("b").alias("removed"))
    renamed = (F.col("added") == 1) & (F.col("removed") == 1)
    keep = lambda c: F.when(renamed, 0).otherwise(F.col(c)).alias(c)
    return per.select("file", "kind", keep("added"), keep("removed"), renamed.cast("int").alias("renamed"))


def operation(added: Column, removed: Column, renamed: Column, moved: Column) -> Column:
    """What a change of symbols and edges is: rewire or internal without changed symbols, rename, extract, inline, or restructure."""
    none = (added == 0) & (removed == 0)
    return F.when(none & (renamed == 0), F.when(moved, "rewire").otherwise("internal")).when(none, "rename").when(removed == 0, "extract").when(added == 0, "inline").otherwise("restructure")


def partition_join(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, split, merged, same): classes of keying a that b splits, classes of b that join several of a; vacuous keyings, of one class, are refused as null."""
    pairs = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    split = pairs.groupBy("a").agg((F.count("*") > 1).cast("int").alias("s")).agg(F.sum("s").alias("split"), F.count("*").alias("n_a"))
    merged = pairs.groupBy("b").agg((F.count("*") > 1).cast("int").alias("m")).agg(F.sum("m").alias("merged"), F.count("*").alias("n_b"))
    both = split.join(F.broadcast(merged))  # one row each
    same = F.when((F.col("n_a") > 1) & (F.col("n_b") > 1), (F.col("split") == 0) & (F.col("merged") == 0))
    return both.select("n_a", "n_b", "split", "merged", same.alias("same"))


def index_audit(derived: DataFrame, live: DataFrame) -> DataFrame:
    """(side, n): rows of the derived index that the live one lacks, and the reverse, as multisets."""
    n = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(derived.exceptAll(live), "missing").union(n(live.exceptAll(derived), "stale"))


def layered(layers: DataFrame) -> DataFrame:
    """(path, value, layer, n_overrides, n_noops) of layers (path, layer, value): the last layer's value, and overrides that change nothing."""
    before = F.lag("value").over(Window.partitionBy("path").orderBy("layer"))
    marked = layers.withColumn("_p", before).withColumn("_first", F.row_number().over(Window.partitionBy("path").orderBy("layer")) == 1)
    last = F.max(F.struct("layer", "value"))
    over = F.count(F.when(~F.col("_first"), 1)).alias("n_overrides")
    noop = F.count(F.when(~F.col("_first") & F.col("_p").eqNullSafe(F.col("value")), 1)).alias("n_noops")
    return marked.groupBy("path").agg(last.alias("l"), over, noop).select("path", "l.value", "l.layer", "n_overrides", "n_noops")


def drift(members: DataFrame) -> DataFrame:
    """(family, path, member, value, kind) of members (family, path, member, value) that differ from what most of their family hold there, ties to the least value.

    lone: the family holds one other value; varied: it holds several.
    """
    counts = members.groupBy("family", "path", "value").agg(F.count("*").alias("n"))
    per = counts.groupBy("family", "path").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).getField("value").alias("usual"), F.count("*").alias("kinds"))
    j = members.join(per, ["family", "path"]).where(~F.col("value").eqNullSafe(F.col("usual")))
    return j.select("family", "path", "member", "value", F.when(F.col("kinds") == 2, "lone").otherwise("varied").alias("kind"))


def top_examples(rows: DataFrame, by: list[str], order: list, k: int = 3) -> DataFrame:
    """The first k rows of each group; Spark cuts groups in every map task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def interleave(rows: DataFrame) -> DataFrame:
    """(fn, n, switches, span) of statements (fn, line, concern) in source order: changes of concern, and the most lines that one concern spans."""
    turn = F.lag("concern").over(Window.partitionBy("fn").orderBy("line"))
    marked = rows.withColumn("_t", turn)
    per = marked.groupBy("fn").agg(F.count("*").alias("n"), F.count(F.when(F.col("_t") != F.col("concern"), 1)).alias("switches"))
    spans = rows.groupBy("fn", "concern").agg((F.max("line") - F.min("line")).alias("s")).groupBy("fn").agg(F.max("s").alias("span"))
    return per.join(spans, "fn")


def load_order(uses: DataFrame, definitions: DataFrame, order: DataFrame) -> DataFrame:
    """(name, user, owner): uses (file, name) whose definition (file, name) stands in a file that loads later, by order (file, position)."""
    u = uses.join(order, "file").select("name", F.col("file").alias("user"), F.col("position").alias("at"))
    d = definitions.join(order, "file").select("name", F.col("file").alias("owner"), F.col("position").alias("from"))
    return u.join(d, "name").where("at < from").select("name", "user", "owner").distinct()


def ties(rows: DataFrame, order: list[str]) -> DataFrame:
    """(order columns, n): places that an ordering leaves several rows in, so it isn't total."""
    return rows.groupBy(*order).agg(F.count("*").alias("n")).where("n > 1")


def constants(bindings: DataFrame) -> DataFrame:
    """(file, name, value): names that a file binds once, to a literal."""
    per = bindings.groupBy("file", "name").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    return per.where("n = 1 and value is not null").select("file", "name", "value")


def nilability(args: DataFrame) -> DataFrame:
    """(target, i, label) of arguments (target, i, nil): always, never or sometimes nil over all call sites; unknown where no site says."""
    per = args.groupBy("target", "i").agg(F.count("nil").alias("k"), F.sum(F.col("nil").cast("long")).alias("n"))
    return per.select("target", "i", F.when(F.col("k") == 0, "unknown").when(F.col("n") == 0, "never").when(F.col("n") == F.col("k"), "always").otherwise("maybe").alias("label"))


def commutes(writes: DataFrame, reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, verdict) of pairs of calls: a conflict if one writes what the other reads or writes, unless both only set it once (tier 3)."""
    w = writes.select("fn", "key", "tier")
    both = lambda x, y, other, test: pairs.join(w.toDF(x, "key", "t"), x).join(other.toDF(y, "key", "t2"), [y, "key"]).where(test).select("a", "b")
    ww = both("a", "b", w, "not (t = 3 and t2 = 3)")
    r = reads.select("fn", "key", F.lit(0).alias("tier"))
    bad = ww.union(both("a", "b", r, "true")).union(both("b", "a", r, "true")).distinct().withColumn("bad", F.lit(True))
    return pairs.join(bad, ["a", "b"], "left").select("a", "b", F.when(F.col("bad"), "conflict").otherwise("commute").alias("verdict"))


def blind_spot(keys: DataFrame, cap: int) -> DataFrame:
    """(id, least): bodies whose every key (id, key) stands in more than cap bodies."""
    k = keys.distinct()
    n = k.groupBy("key").agg(F.count("*").alias("n"))
    return k.join(n, "key").groupBy("id").agg(F.min("n").alias("least")).where(F.col("least") > cap)


def jaccard(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b| of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def djb2(text: Column) -> Column:
    """33 h + c over the bytes of a text from 5381 on, modulo 2 ** 32."""
    data = F.encode(text, "UTF-8")
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(data))), lambda i: F.when(i <= F.octet_length(data), F.conv(F.hex(data.substr(i, F.lit(1))), 16, 10).cast("long")))
    return F.aggregate(F.filter(codes, lambda c: c.isNotNull()), F.lit(5381).cast("long"), lambda h, c: F.pmod(h * 33 + c, F.lit(1 << 32).cast("long")))
