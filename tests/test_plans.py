"""What the plans must and must not contain."""

import pytest

from __spark_entry__ import queries
from vitalscope.plans import catalog, catalog_models

PLAIN = sorted(set(queries()) - set(catalog_models.QUERIES))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_join_anywhere(spark, folder, name):
    plan = plan_of(queries()[name](spark, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_what_is_used(spark, folder):
    plan = plan_of(catalog.triage_errors(spark, folder))
    assert "ReadSchema: struct<o_totalprice:double,o_orderpriority:string>" in plan
    plan = plan_of(catalog.cluster_summary(spark, folder))
    assert "props" not in plan
    assert "PushedFilters: [IsNotNull(label), LessThan(label,7)]" in plan_of(catalog.clustered(spark, folder))


def test_text_stages_do_not_shuffle(spark, folder):
    # The one exchange spreads the single small file over the cores.
    for query in (catalog.normalize_text, catalog.clean_text, catalog.explain_stages,
                  catalog.bilingual_preprocess):
        plan = plan_of(query(spark, folder))
        assert "hashpartitioning" not in plan and plan.count("Exchange") == 1


def test_spelling_repair_runs_once_per_row(spark, folder):
    plan = plan_of(catalog.preprocess_text(spark, folder))
    assert plan.count("ArrowEvalPython") == 1 and plan.count("repair(") == 1


def test_corpus_is_exploded_once_for_the_statistics(spark, folder):
    df = catalog.stopword_stats(spark, folder)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final or plan_of(df).count("ReusedExchange") > 0
