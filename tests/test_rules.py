"""Rule text, parsing, evaluation, logs."""

import pytest

from dqspark.operators import results as RS
from dqspark.rules import evaluate as E
from dqspark.rules import ir, parse, render
from dqspark.rules.ir import Guard, Rule


def test_every_type_renders_and_parses():
    for kind in ir.RULE_TYPES:
        if kind == ir.CUSTOM:
            continue
        rule = Rule(kind, "a", Guard(), 0.5, 0.9, ("a", "b"), "x")
        assert parse.parse(render.render(rule))
        where = render.render_where(rule, "d = 1")
        assert where is None if kind in (ir.PRIMARY_KEY, ir.UNIQUENESS) else parse.parse(where)
    with pytest.raises(ValueError):
        render.render(Rule(ir.CUSTOM, "a"))


def test_overrides_and_zero_margins():
    rule = Rule(ir.MEAN, "a", Guard(30, 2, 0.1)).with_overrides(n=7, k=2.5, margin_enabled=False)
    assert "last(7)" in render.render(rule) and "2.5 *" in render.render(rule) and " OR " not in render.render(rule)
    assert "* 1)" not in render.render(Rule(ir.MEAN, "a", Guard(margin=0.0))) and "* 1.0)" in render.render(Rule(ir.MEAN, "a", Guard(margin=0.0)))
    with pytest.raises(ValueError):
        Guard(floor=2, ceiling=1)


def test_hybrid_adds_floor_and_ceiling():
    text = render.render(Rule(ir.FREQ_HYBRID, "a", Guard(floor=1.0, ceiling=9.0), category="x"))
    assert ">= 1.0000" in text and "<= 9.0000" in text and text.startswith("(((")


@pytest.mark.parametrize("text", ["", "Mean", "Mean A >", "Mean A >= 1 extra", "Foo A >= 1", "(Mean A >= 1", "Mean A ~ 1"])
def test_bad_text(text):
    with pytest.raises(parse.RuleSyntaxError):
        parse.parse(text)


def test_evaluation_on_edge_tables(spark):
    schema = "a double, b string"
    rules = {"n": "RowCount = 0", "m": "Mean A >= 0", "c": "Completeness A >= 0.5", "v": 'ColumnValues B in ["x", NULL]', "k": "IsPrimaryKey A B", "s": 'CustomSql "select count(*) from primary where a > 1" >= 0'}
    empty = {r["rule_id"]: r["outcome"] for r in E.evaluate(spark.createDataFrame([], schema), rules).collect()}
    assert empty["n"] == "Passed" and empty["m"] == "Failed" and empty["c"] == "Failed" and empty["s"] == "Passed"
    some = {r["rule_id"]: r["outcome"] for r in E.evaluate(spark.createDataFrame([(1.0, "x"), (None, None)], schema), rules).collect()}
    assert some == {"n": "Failed", "m": "Passed", "c": "Passed", "v": "Passed", "k": "Failed", "s": "Passed"}


def test_logs_with_nothing_and_noise(spark):
    logs = spark.createDataFrame([("a", None), ("b", ""), ("c", "INFO:Mod:[{'rule': 'RowCount >= 1', 'outcome': 'Passed'}]"), ("d", "Resultados GDQ: [broken")], "log_id string, text string")
    found = RS.from_logs(logs).collect()
    assert [(r["log_id"], r["rule"], r["category"]) for r in found] == [("c", "RowCount >= 1", "RowCount")]


def test_stale_after_change(spark):
    cart = spark.createDataFrame([("p", ir.ROW_COUNT, None, "RowCount >= 1")], "proposal_id string, rule_type string, column_name string, rule string")
    logs = spark.createDataFrame([("c", "INFO:Mod:[{'rule': 'RowCount >= 1', 'outcome': 'Passed'}]")], "log_id string, text string")
    out, counts = RS.written_back(cart, RS.from_logs(logs), "now")
    assert counts.first().asDict() == {"matched": 1, "orphaned": 0, "unmatched": 0}
    assert RS.stale(out).count() == 0
    from pyspark.sql import functions as F

    assert RS.stale(out.withColumn("rule", F.lit("RowCount >= 2"))).count() == 1


def test_words_for_everything(spark):
    from dqspark.rules import explain

    for kind in ir.RULE_TYPES:
        assert explain.rule(Rule(kind, "a", Guard(floor=1.0), 0.5, 0.9, ("a",), "x"))
    assert explain.trade_offs(Rule(ir.MEAN, "a")) and not explain.trade_offs(Rule(ir.COMPLETENESS, "a"))
    assert len(explain.regime({"regime": "VOLATILE", "secondary_regimes": ["SPARSE"]})) == 2
    assert explain.result({"outcome": "Failed", "metrics": {"m": 0.5}, "lower_bound": 1.0, "upper_bound": None, "failure_reason": "low"}) == "Failed: m = 0.5; expected 1 to -; low"
    assert explain.history_gap(0, 7) and explain.history_gap(3, 7) and explain.history_gap(9, 7) is None
    assert "latest month" in explain.date_condition("MONTH", "MAX_VALUE")


def test_subpopulations_and_new_parameters(spark):
    import datetime as dt
    import random

    from pyspark.sql import functions as F

    from dqspark.operators import proposals as PR

    r = random.Random(1)
    rows = [(dt.date(2025, 1, 1) + dt.timedelta(i), r.gauss(100, 5), "ab"[j % 2]) for i in range(30) for j in range(8)]
    df = spark.createDataFrame(rows, "period date, x double, g string")
    p = PR.subpopulation(df, "x", "g = 'a'", Guard(10)).persist()
    assert {r["rule_type"] for r in p.collect()} == {ir.MEAN, ir.STDDEV, ir.COMPLETENESS}
    texts = [r["rule"] for r in PR.where_texts(p, "g = 'a'").collect()]
    assert all("from primary where g = 'a'" in t and parse.parse(t) for t in texts)
    from dqspark.operators import history as H

    h = H.numeric(df, "x").withColumn("column_name", F.lit("x"))
    old = PR.recommended(PR.numeric(h, Guard(10)))
    new = PR.recalculated(h, old, Guard(15, 3.0))
    assert new.count() == old.count() and {r["n"] for r in new.collect()} == {15}
