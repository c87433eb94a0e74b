"""Plan checks: no Cartesian products or nested-loop joins, Python only where declared,
column pruning reaches the scan."""

import pytest

from gradebook.plans.catalog import load_all

SF = "/root/testdata/sf0.001"
REG = load_all()
# queries whose plans legitimately contain a Python stage: NFKD, and one XML parse per article
PYTHON_OK = {"normalize_text", "article_elements", "article_sections", "section_inventory", "section_map", "article_metadata", "article_key",
             "article_record", "metadata_append_split", "sections_upsert"}
# agreement queries read their fact table once and never join it to itself
ONE_SCAN = ["global_agreement", "icc", "weighted_kappa", "rater_agreement", "kappa_matrix", "variant_pairs", "contingency", "prompt_agreement",
            "mcnemar_exact", "chi2_association", "stuart_maxwell", "wilcoxon_signed_rank", "wilcoxon_exact", "wilcoxon_small_groups", "agreement_levels"]
SKIP = {"src_responses", "src_repetition_sheets", "src_questions", "src_generations", "src_articles", "stream_landing_batch", "concatenated_json", "json_map_entries", "metadata_append", "stream_metadata_append", "stream_sections_upsert", "src_ratings", "src_judgements", "src_answers", "src_goals", "append_log",
        "sink_tables", "build_prompts_from_files"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REG) - SKIP))
def test_no_cartesian_and_python_only_where_declared(spark, name):
    plan = _plan(REG[name].run(spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    has_python = any(k in plan for k in ("ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "BatchEvalPython"))
    assert has_python == (name in PYTHON_OK), name


def test_scan_is_pruned(spark):
    plan = _plan(REG["accuracy_table"].run(spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


@pytest.mark.parametrize("name", ONE_SCAN)
def test_agreement_reads_its_table_once(spark, name):
    plan = _plan(REG[name].run(spark, SF))
    assert plan.count("FileScan") == 1 and "Join" not in plan


# most scans a plan may hold: the fact table once, and the two of the case numbers for permutations
SCANS = {"permuted_consistency": 3, "observed_vs_random": 3, "pooled_random_baseline": 3, "boot_mean_difference": 3, "boot_mean_consistency": 1,
         "boot_mean_accuracy": 1, "boot_kappa_matrix": 1, "article_record": 1, "dominance": 1,
         "always_correct_or_wrong": 1, "consistency_correctness_heatmap": 1, "box_stats": 1, "completeness_check": 3, "judge_outcomes": 3, "agreement_levels": 1}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_scans(spark, name):
    plan = _plan(REG[name].run(spark, SF))
    assert plan.count("FileScan") <= SCANS[name]
