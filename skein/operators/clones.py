"""Exact, block and near clones over statement rows, and inverted mention indexes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.lineage import cut

#: Rarely shared keys make near pairs: those in 2 to 30 bodies.
POST_CAP = 30
#: Bodies without a key in 2 to 30 bodies also take keys in up to 64.
RESCUE_CAP = 64


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def exact(bodies: DataFrame, key: str = "body") -> DataFrame:
    """Groups of bodies (id, body) that are equal: how many, and the first."""
    return bodies.where(F.col(key).isNotNull()).groupBy(F.sha2(key, 256).alias("hash")).agg(F.count("*").alias("size"), F.min("id").alias("first")).where("size > 1")


def blocks(rows: DataFrame, length: int = 3) -> DataFrame:
    """Runs of `length` rows (id, lines) that stand in several bodies: how many places and bodies, and the first."""
    runs = rows.select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("lines") - length + 1)), lambda i: F.when(F.size("lines") >= length, F.sha2(F.array_join(F.slice("lines", i, length), "\n"), 256)))).alias("at", "run")).where("run is not null")
    return runs.groupBy("run").agg(F.count("*").alias("n_places"), F.countDistinct("id").alias("n_bodies"), F.min("id").alias("first")).where("n_bodies > 1")


def near(keys: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, shared) of bodies that share at least `least` keys (id, key) found in 2 to 30 bodies, so no key makes many pairs."""
    rare = keys.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, POST_CAP)).select("key")
    k = keys.distinct().join(rare, "key")
    return k.alias("x").join(k.alias("y"), "key").where("x.id < y.id").groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def _shared(keys: DataFrame) -> DataFrame:
    """(id, key, n): the distinct keys of bodies, as 16 bytes each, that stand in n > 1 bodies."""
    k = keys.select("id", F.unhex(F.md5("key")).alias("key")).distinct()
    return cut(k.join(k.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").select("id", "key", "n"))


def near_rescued(keys: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, shared) as near() finds them, and more: bodies that have no key found in 2 to 30 bodies bring theirs found in up to 64.

    A pair with such a body needs one shared key only, as it has hardly any. All pairs of near() are among these.
    """
    k = _shared(keys)
    blind = k.groupBy("id").agg(F.min("n").alias("least")).where(F.col("least") > POST_CAP).select("id", F.lit(True).alias("blind"))
    k = k.where(F.col("n") <= RESCUE_CAP).join(blind, "id", "left")
    rescued = k.where("blind").select("key").distinct()
    k = k.where(F.col("n") <= POST_CAP).unionByName(k.where(F.col("n") > POST_CAP).join(rescued, "key", "semi"))
    pairs = k.alias("x").join(k.alias("y"), "key").where("x.id < y.id").groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    pairs = pairs.agg(F.count("*").alias("shared"), F.max(F.coalesce("x.blind", "y.blind", F.lit(False))).alias("blind"))
    return pairs.where((F.col("shared") >= least) | F.col("blind")).select("a", "b", "shared")


def common_classes(keys: DataFrame) -> DataFrame:
    """(id, class, size, n_keys): bodies with the same set of keys found in more than 30 bodies, named by their smallest; no pair is made."""
    k = _shared(keys).where(F.col("n") > POST_CAP)
    sets = k.groupBy("id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_set("key")), F.hex), ","), 256).alias("set"), F.count("*").alias("n_keys"))
    found = sets.groupBy("set").agg(F.min("id").alias("class"), F.count("*").alias("size")).where("size > 1")
    return sets.join(found, "set").select("id", "class", "size", "n_keys")


def row_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Least rows to replace, insert or delete between a and b, or most + 1 if more: runs of equal rows are skipped along few diagonals, whole arrays at a time."""

    def run(i: int, k: int) -> int:
        n = min(len(a) - i, len(b) - i - k)
        differ = np.flatnonzero(a[i : i + n] != b[i + k : i + k + n])
        return i + (int(differ[0]) if len(differ) else n)

    goal = len(b) - len(a)
    far = {0: run(0, 0)}
    for dist in range(most + 1):
        if far.get(goal, -1) == len(a):
            return dist
        ahead = {}
        for k in range(-dist - 1, dist + 2):
            i = max(far.get(k, -2) + 1, far.get(k - 1, -1), far.get(k + 1, -2) + 1)
            i = min(i, len(a), len(b) - k)
            if i >= max(0, -k):
                ahead[k] = run(i, k)
        far = ahead
    return most + 1


def aligned(pairs: DataFrame, bodies: DataFrame, most: int = 2, least_rows: int = 6) -> DataFrame:
    """(a, b, dist, matched) of pairs (a, b) whose rows (id, lines) differ in 1 to `most` places: rows replaced, inserted or deleted.

    matched, the longer body's rows less dist, is `least_rows` or more. Lines are compared by 64-bit hashes; bodies whose lengths rule the distance out are never compared.
    """
    rows = bodies.where("lines is not null").select("id", F.transform("lines", lambda x: F.xxhash64(x)).alias("lines")).withColumn("n", F.size("lines"))
    j = pairs.select("a", "b").join(rows.toDF("a", "x", "nx"), "a").join(rows.toDF("b", "y", "ny"), "b").where((F.abs(F.col("nx") - F.col("ny")) <= most) & (F.greatest("nx", "ny") > least_rows))

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([row_distance(a, b, most) for a, b in zip(x, y)], dtype="int32")

    j = j.select("a", "b", F.greatest("nx", "ny").alias("rows"), distance("x", "y").alias("dist")).where(F.col("dist").between(1, most))
    return j.select("a", "b", "dist", (F.col("rows") - F.col("dist")).alias("matched")).where(F.col("matched") >= least_rows)


def postings(mentions: DataFrame) -> DataFrame:
    """Of each name (file, name): in how many files, the first and the last."""
    return mentions.distinct().groupBy("name").agg(F.count("*").alias("n_files"), F.min("file").alias("first"), F.max("file").alias("last"))
