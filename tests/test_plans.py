"""Plans: rules by issue code, recipes, folding, and results on small tables with known answers."""

import pytest

from loomtext.catalog import Catalog
from loomtext.plans import PlanError, RecipeError, check_plan, expand, patch, run_plan
from loomtext.plans.run import frame, row_cap


@pytest.fixture(scope="module")
def catalog(spark):
    docs = spark.createDataFrame(
        [("d1", "r1", "t", "t", "2025-03-10T00:00:00", "A"), ("d2", "r2", "t", "t", "2026-04-15T00:00:00", "B"), ("d3", "r3", "t", "t", "2026-05-01T00:00:00", "A")],
        "doc_id string, row_id string, raw_text string, cleaned_text string, created_at string, channel string",
    )
    clauses = spark.createDataFrame(
        [("d1", "c1", "x", "neutral", "contents"), ("d2", "c2", "x", "positive", "atmosphere"), ("d2", "c3", "x", "positive", "food"), ("d3", "c4", "x", "negative", "food"), ("d3", "c5", "x", "positive", "atmosphere")],
        "doc_id string, clause_id string, clause string, sentiment string, aspect string",
    )
    numbers = spark.createDataFrame([(1, 2.5, True)], "n long, x double, ok boolean")
    return Catalog().register("docs", docs).register("clauses", clauses, strict=False).register("numbers", numbers)


def plan(*steps):
    return {"plan_version": "v2", "steps": list(steps)}


def step(skill, name="s", **params):
    return {"id": name, "skill": skill, "params": params}


COUNT = [{"name": "count", "function": "count", "column": "*"}]
KEYED = {"left": "docs", "right": "docs", "join_key": ["doc_id"], "left_label": "x", "right_label": "y"}
PERIODS = {"input": "docs", "period_a": {"start": "2025-01-01", "end": "2025-12-31"}, "period_b": {"start": "2026-01-01", "end": "2026-12-31"}}

NEGATIVE = [
    ("plan.not_object", []),
    ("plan.version_mismatch", {"plan_version": "v1", "steps": [step("present", input="docs")]}),
    ("plan.steps_not_list", {"plan_version": "v2", "steps": {}}),
    ("plan.steps_empty", plan()),
    ("plan.reason_invalid", {"answerable": False, "reason": "x", "message": "m"}),
    ("plan.reject_message_required", {"answerable": False, "reason": "unsupported_skill"}),
    ("plan.reject_steps_not_empty", {"answerable": False, "reason": "unsupported_skill", "message": "m", "steps": [1]}),
    ("plan.capability_gap_not_object", {"answerable": False, "reason": "unsupported_skill", "message": "m", "capability_gap": 1}),
    ("step.not_object", plan(1)),
    ("step.id_missing", plan({"skill": "present", "params": {"input": "docs"}})),
    ("step.id_invalid", plan(step("present", "bad-id", input="docs"))),
    ("step.id_reserved", plan(step("present", "docs", input="docs"))),
    ("step.id_duplicated", plan(step("present", input="docs"), step("present", input="docs"))),
    ("step.skill_missing", plan({"id": "s", "params": {}})),
    ("step.skill_unknown", plan(step("summarize", input="docs"))),
    ("step.params_not_object", plan({"id": "s", "skill": "present", "params": []})),
    ("params.missing_keys", plan(step("filter", input="docs"))),
    ("params.input_missing", plan(step("present", input=""))),
    ("params.input_unknown", plan(step("present", input="nowhere"))),
    ("params.input_forward_ref", plan(step("present", "a", input="b"), step("present", "b", input="docs"))),
    ("params.column_unknown", plan(step("filter", input="docs", column="zzz", operator="eq", value=1))),
    ("params.on_not_list", plan(step("join", left="docs", right="docs", on="doc_id"))),
    ("params.on_not_string_list", plan(step("join", left="docs", right="docs", on=[1]))),
    ("params.join_key_unknown", plan(step("join", left="docs", right="numbers", on=["doc_id"]))),
    ("params.how_invalid", plan(step("join", left="docs", right="docs", on=["doc_id"], how="cross"))),
    ("params.operator_invalid", plan(step("filter", input="docs", column="doc_id", operator="like", value="x"))),
    ("params.value_unexpected", plan(step("filter", input="docs", column="doc_id", operator="is_null", value="x"))),
    ("params.value_not_list", plan(step("filter", input="docs", column="doc_id", operator="in", value="x"))),
    ("params.value_between_arity", plan(step("filter", input="numbers", column="n", operator="between", value=[1]))),
    ("params.value_type_mismatch", plan(step("filter", input="docs", column="doc_id", operator="eq", value=1))),
    ("params.value_type_mismatch", plan(step("filter", input="numbers", column="n", operator="contains", value="1"))),
    ("params.group_by_not_list", plan(step("aggregate", input="docs", group_by="channel", metrics=COUNT))),
    ("params.metrics_not_list", plan(step("aggregate", input="docs", group_by=[], metrics={}))),
    ("params.metric_not_object", plan(step("aggregate", input="docs", group_by=[], metrics=["count"]))),
    ("params.metric_name_missing", plan(step("aggregate", input="docs", group_by=[], metrics=[{"function": "count"}]))),
    ("params.metric_name_duplicated", plan(step("aggregate", input="docs", group_by=[], metrics=COUNT + COUNT))),
    ("params.metric_name_label_prefix", plan(step("aggregate", input="docs", group_by=[], metrics=[{"name": "a_count", "function": "count"}]))),
    ("params.metric_name_collides_group_by", plan(step("aggregate", input="docs", group_by=["channel"], metrics=[{"name": "channel", "function": "count"}]))),
    ("params.metric_function_invalid", plan(step("aggregate", input="docs", group_by=[], metrics=[{"name": "m", "function": "median", "column": "doc_id"}]))),
    ("params.metric_column_missing", plan(step("aggregate", input="docs", group_by=[], metrics=[{"name": "m", "function": "sum"}]))),
    ("params.metric_column_not_numeric", plan(step("aggregate", input="docs", group_by=[], metrics=[{"name": "m", "function": "sum", "column": "channel"}]))),
    ("params.join_key_not_list", plan(step("compare", **{**KEYED, "join_key": "doc_id"}))),
    ("params.join_key_empty_not_scalar", plan(step("compare", **{**KEYED, "join_key": []}))),
    ("params.compare_join_key_unknown", plan(step("compare", **{**KEYED, "join_key": ["zzz"]}))),
    ("params.left_label_missing", plan(step("compare", **{**KEYED, "left_label": ""}))),
    ("params.right_label_unsafe", plan(step("compare", **{**KEYED, "right_label": "a b"}))),
    ("params.compare_labels_identical", plan(step("compare", **{**KEYED, "right_label": "x"}))),
    ("params.expressions_not_list", plan(step("calculate", input="numbers", expressions={}))),
    ("params.expression_not_object", plan(step("calculate", input="numbers", expressions=[1]))),
    ("params.expression_name_missing", plan(step("calculate", input="numbers", expressions=[{"operation": "add", "left": "n", "right": "n"}]))),
    ("params.expression_name_duplicated", plan(step("calculate", input="numbers", expressions=[{"name": "n", "operation": "add", "left": "n", "right": "n"}]))),
    ("params.expression_operation_invalid", plan(step("calculate", input="numbers", expressions=[{"name": "y", "operation": "power"}]))),
    ("params.expression_keys_missing", plan(step("calculate", input="numbers", expressions=[{"name": "y", "operation": "add", "left": "n"}]))),
    ("params.expression_column_unknown", plan(step("calculate", input="numbers", expressions=[{"name": "y", "operation": "add", "left": "n", "right": "zzz"}]))),
    ("params.expression_column_not_numeric", plan(step("calculate", input="numbers", expressions=[{"name": "y", "operation": "add", "left": "n", "right": "ok"}]))),
    ("params.expression_partition_by_not_list", plan(step("calculate", input="numbers", expressions=[{"name": "y", "operation": "share_of_total", "value": "n", "partition_by": "n"}]))),
    ("params.by_not_list", plan(step("sort", input="docs", by="doc_id"))),
    ("params.sort_by_unknown", plan(step("sort", input="docs", by=["zzz"]))),
    ("params.order_invalid", plan(step("sort", input="docs", by=["doc_id"], order="up"))),
    ("params.limit_invalid", plan(step("sort", input="docs", by=["doc_id"], limit=0))),
    ("params.limit_cap_exceeded", plan(step("sort", input="docs", by=["doc_id"], limit=10_001))),
    ("params.format_invalid", plan(step("present", input="docs", format="pie"))),
    ("params.columns_not_list", plan(step("present", input="docs", columns="doc_id"))),
    ("params.columns_invalid", plan(step("present", input="docs", columns=[1]))),
    ("params.columns_unknown", plan(step("present", input="docs", columns=["zzz"]))),
    ("params.recipe_period_invalid", plan(step("period_compare_count", **{**PERIODS, "period_a": {"start": "2026-02-01", "end": "2026-01-01"}}))),
    ("params.recipe_date_column_invalid", plan(step("period_compare_count", **{**PERIODS, "date_column": ""}))),
    ("params.recipe_group_by_invalid", plan(step("distribution", input="docs", group_by=[]))),
    ("params.recipe_metric_unsupported", plan(step("distribution", input="docs", group_by=["channel"], metric="sum"))),
    ("params.recipe_title_invalid", plan(step("distribution", input="docs", group_by=["channel"], title=1))),
    ("params.recipe_include_share_invalid", plan(step("distribution", input="docs", group_by=["channel"], include_share="yes"))),
    ("params.recipe_column_name_invalid", plan(step("distribution", input="docs", group_by=["channel"], count_column=""))),
    ("params.recipe_event_date_invalid", plan(step("event_window_count", input="docs", event_date="soon"))),
    ("params.recipe_window_invalid", plan(step("event_window_count", input="docs", event_date="2026-01-01", before_days=-1))),
    ("params.recipe_grain_unsupported", plan(step("event_window_count", input="docs", event_date="2026-01-01", grain="week"))),
    ("params.recipe_filter_invalid", plan(step("top_n", input="docs", group_by=["channel"], filters=[{"column": "channel", "op": "~", "value": 1}]))),
    ("params.recipe_filter_value_invalid", plan(step("top_n", input="docs", group_by=["channel"], filters=[{"column": "channel", "op": "in", "value": "A"}]))),
    ("params.recipe_sort_invalid", plan(step("top_n", input="docs", group_by=["channel"], sort={"column": "doc_id"}))),
    ("params.recipe_limit_invalid", plan(step("sample_rows", input="docs", columns=["doc_id"], limit=101))),
    ("params.recipe_columns_invalid", plan(step("sample_rows", input="docs", columns=[]))),
]


@pytest.mark.parametrize(("code", "bad"), NEGATIVE, ids=[f"{c}-{k}" for k, (c, _) in enumerate(NEGATIVE)])
def test_issue(catalog, code, bad):
    assert code in [i.code for i in check_plan(bad, catalog)]
    with pytest.raises(PlanError):
        frame(bad, catalog)


def rows(result):
    return [tuple(r) for r in result.rows]


def test_periods_in_all_and_by_group(catalog):
    assert rows(run_plan(plan(step("period_compare_count", **PERIODS)), catalog)) == [(1, 2, 1, 100.0)]
    grouped = run_plan(plan(step("period_compare_count", **PERIODS, group_by=["channel"])), catalog)
    assert sorted(rows(grouped), key=str) == [("A", 1, 1, 0, 0.0), ("B", None, 1, 1, None)]
    shares = run_plan(plan(step("period_compare_distribution", **PERIODS, group_by=["channel"])), catalog)
    assert sorted(rows(shares), key=str) == [("A", 1, 1.0, 1, 0.5, 0, -0.5), ("B", None, None, 1, 0.5, 1, 0.5)]


def test_scalar_comparison(catalog):
    got = run_plan(
        plan(
            step("aggregate", "every", input="clauses", group_by=[], metrics=COUNT),
            step("filter", "pos", input="clauses", column="sentiment", operator="eq", value="positive"),
            step("aggregate", "good", input="pos", group_by=[], metrics=COUNT),
            step("compare", "both", left="every", right="good", join_key=[], left_label="all", right_label="positive"),
            step("present", "out", input="both", title="t", format="chart"),
        ),
        catalog,
        debug=True,
    )
    assert (got.columns, rows(got), got.title, got.format) == (["all_count", "positive_count"], [(5, 3)], "t", "chart")
    assert got.samples["pos"][0] == 3 and set(got.samples) == {"every", "pos", "good", "both"}


def test_aspect_change_with_vanished_and_new_aspects(catalog):
    got = run_plan(
        plan(
            step("join", "j", left="clauses", right="docs", on=["doc_id"], how="inner"),
            step("filter", "last", input="j", column="created_at", operator="lt", value="2026-05-01"),
            step("filter", "this", input="j", column="created_at", operator="gte", value="2026-05-01"),
            step("aggregate", "la", input="last", group_by=["aspect"], metrics=COUNT),
            step("aggregate", "ta", input="this", group_by=["aspect"], metrics=COUNT),
            step("compare", "c", left="la", right="ta", join_key=["aspect"], left_label="last", right_label="this"),
            step("calculate", "d", input="c", expressions=[{"name": "delta", "operation": "percent_change", "base": "last_count", "current": "this_count"}]),
            step("sort", "s", input="d", by=["aspect"], order="asc"),
        ),
        catalog,
    )
    assert rows(got) == [("atmosphere", 1, 1, 0.0), ("contents", 1, None, -100.0), ("food", 1, 1, 0.0)]


def test_a_recipe_can_be_read_by_later_steps(catalog):
    got = run_plan(plan(step("distribution", "d", input="docs", group_by=["channel"]), step("sort", "s", input="d", by=["count"], limit=1)), catalog)
    assert [r[:2] for r in rows(got)] == [("A", 2)] and got.total_rows == 1


def test_expansion_is_fixed_and_raises(catalog):
    steps = [step("event_window_count", "w", input="docs", event_date="2026-05-01", before_days=1, after_days=0)]
    assert expand(steps) == expand(steps)
    assert [s["params"].get("value") for s in expand(steps)[:2]] == ["2026-04-30", "2026-05-02"]
    with pytest.raises(RecipeError):
        expand([step("top_n", input="docs", group_by=[])])


def test_row_caps(catalog):
    assert [row_cap(v) for v in (None, 5, 0, True, "9", 99_999)] == [1000, 5, 1000, 1000, 1000, 10_000]
    got = run_plan(plan(step("present", input="docs", max_rows=2)), catalog)
    assert (len(got.rows), got.total_rows, got.truncated) == (2, 3, True)


def test_refused_plans_have_no_frame(catalog):
    refused = {"answerable": False, "reason": "unsupported_skill", "message": "no"}
    assert not check_plan(refused, catalog)
    with pytest.raises(PlanError):
        frame(refused, catalog)


def test_patches():
    old = plan(step("sort", "s", input="docs", by=["doc_id"]), step("present", "p", input="s"))
    assert patch(old, format="chart")["steps"][1]["params"]["format"] == "chart"
    assert patch(old, limit=3)["steps"][0]["params"]["limit"] == 3 and "limit" not in old["steps"][0]["params"]
    assert patch(plan(step("present", "p", input="docs")), limit=3) is None and patch(old, format="pie") is None


def test_contracts(spark):
    with pytest.raises(ValueError, match="lacks"):
        Catalog().register("docs", spark.createDataFrame([(1,)], "doc_id long"))
    with pytest.raises(ValueError, match="name"):
        Catalog().register("bad name", spark.createDataFrame([(1,)], "a long"))


def test_the_flagship_is_one_job_of_two_scans(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["event_type", "a_count", "b_count", "delta_count", "delta_rate"] and df.count() == 5
    plan_text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan_text and "CartesianProduct" not in plan_text
