"""What queries shuffle and make, in rows for each row of their result or input, which is to stay the same as tables grow."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from skein.operators import diffs, lookups
from skein.sources import dumps
from skein.sources.graph import from_star

SF = "/root/testdata/sf0.001"


def shuffled(spark, run):
    """What run gives, and the rows that all stages wrote for shuffles meanwhile."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    return run(), total() - before


def made(df):
    """The most rows that an operator of df's executed plan gave."""
    df.collect()

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(p.plan())
        else:
            rows = p.metrics().get("numOutputRows")
            yield rows.get().value() if rows.isDefined() else 0
            for i in range(p.children().size()):
                yield from walk(p.children().apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()))


#: By query, the shuffled rows for each row of the result.
MOST = {"cone_out_graph": 5.5, "cone_in_graph": 5.3, "territory_graph": 37, "territory_borders_graph": 40, "scc_levels_graph": 60, "scc_components_graph": 31, "purity_labels": 90, "dominators_graph": 6, "reaching_definitions_graph": 3.4, "taint_reach_graph": 25, "effects_summary_graph": 4.5, "concerns_graph": 35, "region_order": 34, "saturate_paths_graph": 4, "mentioning_in_scope": 6}


@pytest.mark.parametrize("name", sorted(MOST))
def test_rows_shuffled_for_a_row_of_the_result(spark, name):
    n, rows = shuffled(spark, lambda: __spark_entry__.queries()[name](spark, SF).count())
    assert rows <= MOST[name] * n


def test_references_of_one_name_make_no_pairs(spark):
    n = spark.range(400).selectExpr("cast(id as string) id", "'f' file", "'k' kind", "'x' name", "id % 3 witness", "cast(id + 1 as int) ordinal")
    got = lookups.resolve_refs(n.withColumnRenamed("id", "ref"), n)
    assert made(got) <= 2000 and {tuple(r) for r in got.collect()} == {(str(i), str(i), "ordinal") for i in range(400)}


def test_filters_parse_no_line(spark):
    g = dumps.from_lines(dumps.dump_lines(from_star(spark, SF)))
    for part in (g.nodes, g.edges, g.calls):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "json" in line.lower()]


def test_rows_are_dealt_out_before_they_are_counted(spark):
    pairs = diffs.coupling(spark.range(9).select(F.col("id").alias("commit"), F.col("id").alias("symbol")))
    for df in (pairs, from_star(spark, SF).refs()):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_files_whose_ids_repeat_count_once(spark, tmp_path):
    spark.createDataFrame([(1, "en", "a b a"), (1, "en", "a"), (2, "en", "a"), (3, "de", "b b")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in __spark_entry__.queries()["mentioning_in_scope"](spark, str(tmp_path)).collect()} == {("en", "a", 2)}
