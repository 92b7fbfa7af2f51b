"""Physical plans: what may not appear, and what must."""

import pathlib
import re

import pytest

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()
PYTHON = {"udf_batch_map", "udf_group_collate"}
PRODUCTS = {"pending_grid"}  # the product of two work lists is the feature
# the corpus operators have plan tests of their own
QUERIES = {k: v for k, v in QUERIES.items() if k != "pipeline" and not re.match(r"op\d+_", k)}
RUNS_LONG = {"linear_probe", "kmer_probe", "pca", "pca_explained", "kmeans_scores", "stream_loss_rollup",
             "stream_early_stop", "stream_tokenise", "stream_chunks", "pca_lengths", "pca_by_type", "probe_folds", "merge_results", "finished_runs",
             "near_dedup", "pretokenised_write", "stream_windowed_log", "kmeans_fit"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS_LONG))
def test_no_cross_join_and_no_python(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    if name not in PRODUCTS:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("Python" in plan or "ArrowEval" in plan or "InPandas" in plan) == (name in PYTHON)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS_LONG))
def test_windows_without_keys_only_see_block_groups(spark, sf, name):
    """In one task meet only counts: of groups of blocks, or of hash blocks."""
    for line in plan_of(QUERIES[name](spark, sf)).splitlines():
        for first in re.findall(r"windowspecdefinition\(([^,]*),", line):
            unkeyed = re.search(r" (ASC|DESC) ", first) or first.startswith("specifiedwindowframe")
            assert not unkeyed or "_group" in line or "sum(_n#" in line, line


@pytest.mark.parametrize(
    "name,columns",
    [
        ("kfold_sizes", {"doc_id", "quality", "toxic", "vec_id", "label"}),
        ("lineitem_mean_se", {"l_discount", "l_returnflag", "l_linestatus"}),
        ("det_shuffle", {"doc_id"}),
        ("batch_drop_last", {"doc_id"}),
        ("loss_rollup", {"event_id", "user_id", "value"}),
    ],
)
def test_scans_read_only_what_is_used(spark, sf, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](spark, sf)))
    assert {c.split(":")[0] for s in read for c in s.split(",")} <= columns


def test_filters_reach_the_scan(spark, sf):
    plan = plan_of(QUERIES["scan_split"](spark, sf))
    assert "PartitionFilters: [isnotnull(dataset" in plan


def test_library_text():
    """No construct that a lost executor would break, and no hidden broadcast or gathering."""
    root = pathlib.Path(entry_point.__file__).parent / "helixframe"
    for path in root.rglob("*.py"):
        if path.parent.name == "llm":
            continue
        text = path.read_text()
        for word in ("localCheckpoint", "crossJoin", "toPandas", "monotonically_increasing_id", "F.broadcast", ".rdd.map", "collect_list"):
            assert word not in text, f"{word} in {path.name}"


@pytest.mark.parametrize("name,most", [("early_stop", 4), ("step_time", 3), ("optimizer_log", 3)])
def test_log_plans_read_their_input_few_times(spark, sf, name, most):
    """All else is settled: per plan, scans of the events and of the carried tables."""
    plan = plan_of(QUERIES[name](spark, sf))
    assert len(re.findall(r"FileScan parquet .*events\.parquet", plan)) <= most
    assert len(re.findall(r"FileScan parquet .*events\.parquet", plan)) >= 1
