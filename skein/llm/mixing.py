"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.shared import staged, table

#: A document is taken so often at most.
MOST = 3
#: Blocks in the smallest target, shared by the shards: no source misses its target by more than its share of them.
BLOCKS = 1000
SEED = 17
#: Words and rows of a shard.
SHARD_WORDS, SHARD_ROWS = 500_000, 8192


def _word_count(text: Column) -> Column:
    space = [chr(c) for c in (0x20, *range(0x09, 0x0E))]
    outer = lambda at: F.when(F.substring(text, at, 1).isin(space), 1).otherwise(0)
    # White space at either end parts an empty word from the others.
    return F.when(F.length(text) > 0, F.size(F.split(text, r"[\x20\x09-\x0D]+")) - outer(1) - outer(-1)).otherwise(0).cast("long")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with weight and target; one row per source is all that meets in one task.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the sum of sizes by weight; those above
    `most` times their source's size stop there and the excess is shared by weight again. With sources ordered by
    size / weight, those that stop come first: the level is the one of the first source that needn't stop.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    rise = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = w.withColumn("before", F.coalesce(F.sum("source_size").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("weights", F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing))).withColumn("total", F.sum("source_size").over(every))
    w = w.withColumn("level", (F.col("total") - most * F.col("before")).cast("double") / F.col("weights").cast("double"))
    w = w.withColumn("place", F.row_number().over(rise))
    first = F.min(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.struct("place", "level"))).over(every)
    w = w.withColumn("first", first)
    stops = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    level = F.when(stops, (most * F.col("source_size")).cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return w.select(*sizes.columns, "weight", F.coalesce(level, F.lit(0.0)).alias("target"))


def apportion(rows: DataFrame, group: list[str], key: list[str], weight: str, seats: str, most: str | None = None) -> DataFrame:
    """rows with `quota`: Sainte-Laguë's division of each group's seats by weight, at most `most` to a row.

    Seats go to the highest quotients weight / (2 k + 1). Two divisors bound each row's seats from below and above by
    rounding weight / divisor; only the quotients between these bounds, two a row on average, are made and ranked.
    Ties go by key. Rows without weight get none.
    """
    by = Window.partitionBy(*group)
    total, n = F.sum(weight).over(by), F.count("*").over(by)
    rows = rows.withColumn("_total", total.cast("double")).withColumn("_n", n)
    share = F.when(F.col("_total") > 0, F.col(weight) / F.col("_total")).otherwise(0.0)
    low = F.greatest(F.lit(0), F.floor(share * F.greatest(F.lit(0.0), F.col(seats) - F.col("_n") / 2.0) + 0.5 - 1e-9)).cast("long")
    high = F.when(share > 0, F.floor(share * (F.col(seats) + F.col("_n") / 2.0) + 0.5 + 1e-9) + 1).otherwise(0).cast("long")
    rows = rows.withColumn("_low", low).withColumn("_high", high)
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_low").over(by))
    bids = rows.where("_high > _low").select(*group, *key, weight, "_left", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"))
    bids = bids.withColumn("_rank", F.row_number().over(by.orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], "_k")))
    won = bids.where("_rank <= _left").groupBy(*group, *key).agg(F.count("*").alias("_won"))
    on = [F.col(f"_r.{c}").eqNullSafe(F.col(f"_w.{c}")) for c in group + key]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    out = rows.alias("_r").join(won.alias("_w"), condition, "left").select("_r.*", (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long").alias("quota"))
    if most:
        out = out.withColumn("quota", F.least("quota", most))
    return out.drop("_total", "_n", "_low", "_high", "_left")


def _sized(docs: DataFrame, seed: int, *more) -> DataFrame:
    """source, size and mark: the seeded hash of id and text that orders a shard."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("")))
    return docs.select(*more, F.col("source").alias("source"), _word_count(F.col("text")).alias("size"), F.md5(key).alias("mark"))


def _taken(sized: DataFrame, most: int, seed: int, shard_words: int, shard_rows: int) -> DataFrame:
    """sized with source_size, target, taken (words) and copies (of whole documents)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    goal = staged(targets(sums, most), "targets")
    n = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_rows") / shard_rows)).cast("long")
    goal = goal.withColumn("shards", n).drop("n_rows")
    least = F.min(F.when(F.col("target") > 0, F.col("target") / F.col("shards"))).over(Window.partitionBy())
    goal = goal.withColumn("block", F.greatest(F.lit(1.0), F.floor(F.coalesce(least, F.lit(1.0)) / BLOCKS)).cast("long"))
    goal = goal.withColumn("seats", F.floor(F.sum("source_size").over(Window.partitionBy()) / F.col("block")).cast("long")).withColumn("all", F.lit(1))
    goal = apportion(goal, ["all"], ["source"], "target", "seats").withColumnRenamed("quota", "blocks").drop("all", "seats", "weight")
    goal = staged(goal, "quotas")
    # The sources' row counts bound this side; Spark splits a hot source's rows, or broadcasts what is under its limit.
    rows = sized.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", "g.source_size", "g.target", "g.shards", "g.block", "g.blocks")
    rows = rows.withColumn("shard", F.pmod(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long"), F.col("shards")))
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("has"), F.first("block").alias("block"), F.first("blocks").alias("blocks"))
    shards = shards.withColumn("cap", F.ceil(most * F.col("has") / F.col("block")).cast("long"))
    shards = apportion(shards, ["source"], ["shard"], "has", "blocks", "cap")
    shards = staged(shards.select("source", "shard", "has", F.least(F.col("quota") * F.col("block"), most * F.col("has")).cast("long").alias("takes")), "shards")
    joined = rows.alias("r").join(shards.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.shard") == F.col("s.shard"))).select("r.*", "s.has", "s.takes")
    stream = Window.partitionBy("source", "shard").orderBy("mark", "size")
    joined = joined.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    has = F.greatest(F.col("has"), F.lit(1))
    joined = joined.withColumn("rounds", F.floor(F.col("takes") / has).cast("long")).withColumn("rest", F.col("takes") - F.floor(F.col("takes") / has) * F.col("has"))
    first = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("place"), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long"), has)
    joined = joined.withColumn("place", first).withColumn("stop", F.col("place") + F.col("rest"))
    over = lambda a, b: F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(F.col("begin"), a))
    rest = over(F.col("place"), F.col("stop")) + over(F.lit(0), F.col("stop") - F.col("has"))
    # A run of words takes the documents that begin in it.
    begins = ((F.col("begin") >= F.col("place")) & (F.col("begin") < F.col("stop"))) | (F.col("begin") < F.col("stop") - F.col("has"))
    copies = F.when(F.col("size") > 0, F.col("rounds") + begins.cast("long")).otherwise(0).cast("long")
    return joined.select(*sized.columns, "source_size", "target", (F.col("rounds") * F.col("size") + rest).cast("long").alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, most: int = MOST, seed: int = SEED, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, source, size, mark, source_size, target, taken and copies, for each row of docs (doc_id, text, source).

    Sources get tokens (here words) towards their targets in equal blocks by Sainte-Laguë's quotients, and so do the
    shards of a source; a shard lists its documents by seeded hash of id and text (mark), and takes whole rounds of all, then its last
    blocks from a seeded place on. So taken sums to a source's quota, cuts at most two documents in a shard, and no document
    exceeds `most` times its size; copies are taken with a run's ends moved to the next document's begin. A source's shards
    grow with its words and rows, so no window holds a whole source; rows that are equal in id and text share a shard.
    Null texts and texts without words have size 0 and take 0. A null source is a source. Repeated rows and
    ids are rows of their own; without rows the result is empty; other columns are ignored.
    """
    return _taken(staged(_sized(docs, seed, F.col("doc_id").cast("long").alias("doc_id")), "sizes"), most, seed, shard_words, shard_rows)


def mixed(docs: DataFrame, most: int = MOST, seed: int = SEED, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of docs as the mix takes them, whole and with all their columns, as many times as their copies.

    Each source is met within two documents a shard. Rows are written once with a number that joins them to their copies, so docs
    need not come in the same order twice. Rows without words aren't taken.
    """
    rows = staged(_sized(docs, seed, F.monotonically_increasing_id().alias("id"), F.struct("*").alias("row")), "numbered")
    taken = staged(_taken(rows.drop("row"), most, seed, shard_words, shard_rows).where("copies > 0").select("id", "copies"), "copies")
    return rows.select("id", "row").join(taken, "id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM d GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, row_number() OVER r AS place,
  (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w WINDOW r AS (ORDER BY source_size / weight, source NULLS LAST)),
f AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM l WHERE level * weight <= 3 * source_size),
t AS (SELECT source, source_size, greatest(1, ceil(source_size / 500000), ceil(n_rows / 8192))::BIGINT AS shards,
  CASE WHEN f.place IS NULL OR l.place < f.place THEN (3 * source_size)::DOUBLE ELSE f.level * weight END AS target FROM l, f),
b AS (SELECT greatest(1, floor(coalesce((SELECT min(target / shards) FROM t WHERE target > 0), 1) / 1000))::BIGINT AS block),
n AS (SELECT floor((SELECT sum(source_size) FROM t) / block)::BIGINT AS seats, block FROM b),
q AS (SELECT source, target / (2 * k + 1) AS quotient, k FROM t, n, LATERAL (SELECT unnest(range(0, ceil(1.1 * seats * target / (SELECT greatest(1, sum(target)) FROM t))::BIGINT + 5)) AS k) WHERE target > 0),
won AS (SELECT source, count(*) AS blocks FROM (SELECT source, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST, k) AS place FROM q) JOIN n ON place <= seats GROUP BY 1),
g AS (SELECT t.*, coalesce(blocks, 0) AS blocks, block FROM t LEFT JOIN won ON t.source IS NOT DISTINCT FROM won.source, n),
r AS (SELECT d.*, source_size, target, block, blocks, ('0x' || substr(mark, 1, 8))::BIGINT % shards AS shard FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
h AS (SELECT source, shard, sum(size) AS has, any_value(block) AS block, any_value(blocks) AS blocks FROM r GROUP BY ALL),
hq AS (SELECT source, shard, blocks, has / (2 * k + 1) AS quotient, k FROM (SELECT *, sum(has) OVER (PARTITION BY source) AS total FROM h), LATERAL (SELECT unnest(range(0, ceil(1.1 * blocks * has / greatest(1, total))::BIGINT + 5)) AS k) WHERE has > 0),
hw AS (SELECT source, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, shard, k) AS place FROM hq) WHERE place <= blocks GROUP BY ALL),
c AS (SELECT h.source, h.shard, has::BIGINT AS has, least(least(coalesce(quota, 0), ceil(3 * has / block)::BIGINT) * block, 3 * has)::BIGINT AS takes FROM h LEFT JOIN hw ON h.source IS NOT DISTINCT FROM hw.source AND h.shard = hw.shard),
e AS (SELECT r.*, greatest(has, 1) AS has, takes, ('0x' || substr(md5('17:place:' || coalesce(r.source, '') || ':' || r.shard), 1, 8))::BIGINT % greatest(has, 1) AS p,
  sum(size) OVER (PARTITION BY r.source, r.shard ORDER BY mark, size ROWS UNBOUNDED PRECEDING) AS stop FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.shard = c.shard)
SELECT doc_id, size, source_size, target, (takes // has * size
  + greatest(0, least(stop, p + takes % has) - greatest(stop - size, p)) + greatest(0, least(stop, p + takes % has - has) - greatest(stop - size, 0)))::BIGINT AS taken FROM e
"""
