"""Registries, factories, vocabularies that mirror each other, near names and callbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import near_cap, osa_distance
from skein.plans.lineage import cut

#: Members of more vocabularies than this tell nothing.
STOP_MEMBER = 25
#: What a name or a path of names looks like.
NAME, PATH = r"^[A-Za-z_][A-Za-z0-9_]*$", r"^[A-Za-z_][A-Za-z0-9_./:-]*$"


def registries(sites: DataFrame) -> DataFrame:
    """Verbs that register: of sites (verb, key, callable), 2 or more, callable at half and at 2 of them, 2 keys or more, 60% of them names."""
    per = sites.groupBy("verb").agg(F.count("*").alias("n_sites"), F.count(F.when(F.col("callable"), 1)).alias("n_callable"), F.countDistinct("key").alias("n_keys"), F.countDistinct(F.when(F.col("key").rlike(NAME), F.col("key"))).alias("n_names"))
    return per.where("n_sites >= 2 and n_callable >= 2 and 2 * n_callable >= n_sites and n_keys >= 2 and 10 * n_names >= 6 * n_keys")


def factories(sites: DataFrame) -> DataFrame:
    """Verbs that make things by name: 30 sites (verb, key) or more, 10 keys, 80% of them names or paths."""
    per = sites.groupBy("verb").agg(F.count("*").alias("n_sites"), F.countDistinct("key").alias("n_keys"), F.countDistinct(F.when(F.col("key").rlike(PATH), F.col("key"))).alias("n_paths"))
    return per.where("n_sites >= 30 and n_keys >= 10 and 10 * n_paths >= 8 * n_keys")


def mirrors(members: DataFrame) -> DataFrame:
    """(a, b, shared) of vocabularies (id, member) that share 4 members and 60% of the smaller one, but aren't equal.

    Members of more than 25 vocabularies are stop words and count nowhere, so no member makes more than 300 pairs.
    """
    m = members.distinct()
    told = m.join(m.groupBy("member").agg(F.count("*").alias("n")).where(F.col("n") <= STOP_MEMBER).select("member"), "member")
    size = told.groupBy("id").agg(F.count("*").alias("size"))
    pairs = told.alias("x").join(told.alias("y"), "member").where("x.id < y.id").groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("shared")).where("shared >= 4")
    both = pairs.join(size.toDF("a", "_a"), "a").join(size.toDF("b", "_b"), "b")
    return both.where("10 * shared >= 6 * least(_a, _b) and not (shared = _a and shared = _b)").select("a", "b", "shared")


def connected(pairs: DataFrame) -> DataFrame:
    """(node, family): the smallest node that links (a, b) lead to. Labels spread and jump, so rounds grow with the logarithm of a chain's length."""
    links = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    label = cut(links.select(F.col("a").alias("node"), F.col("a").alias("family")).distinct())
    while True:
        low = links.join(label.toDF("b", "_low"), "b").groupBy(F.col("a").alias("node")).agg(F.min("_low").alias("_low"))
        near = label.join(low, "node").select("node", F.least("family", "_low").alias("_near"), F.col("family").alias("_old"))
        far = label.toDF("_near", "_far")
        new = cut(near.join(far, "_near").select("node", F.least("_near", "_far").alias("family"), (F.least("_near", "_far") < F.col("_old")).alias("moved")))
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            return label


def near_pairs(names: DataFrame) -> DataFrame:
    """(name, near, distance) of names (id, name) within the cap of the first one's length; the first is that of the smaller id.

    Names within two edits have a form in common that comes of leaving out two characters or fewer on each side, so an
    equi-join of those forms finds them all; the distance is then counted.
    """
    less = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), lambda i: F.concat(c.substr(F.lit(1), i - 1), c.substr(i + 1, F.length(c))))
    n = names.where("name is not null").groupBy("name").agg(F.min("id").alias("id"))
    one = less(F.col("name"))
    forms = n.select("id", "name", F.explode(F.array_distinct(F.concat(F.array("name"), one, F.flatten(F.transform(one, less))))).alias("_form"))
    pairs = forms.alias("a").join(forms.alias("b"), "_form").where("a.id < b.id").select("a.name", F.col("b.name").alias("near")).distinct()
    return pairs.withColumn("distance", osa_distance("name", "near")).where(F.col("distance") <= near_cap(F.col("name")))


def callbacks(transitions: DataFrame) -> DataFrame:
    """(state, label): what runs on leaving a state by its transitions (name, source, target), each label once."""
    t, s, to = F.col("name"), F.col("source"), F.col("target")
    labels = [F.concat(F.lit(p), c) for p, c in (("onbefore", t), ("on", t), ("onafter", t), ("onleave", s), ("onenter", to), ("on", to))]
    return transitions.select(s.alias("state"), F.explode(F.array(*labels, F.lit("onstatechange"))).alias("label")).distinct()
