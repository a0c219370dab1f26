import contextlib
import io

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
# model-fitting queries build plans around fitted models; their joins are covered elsewhere
SKIP = {"q_compare", "q_learning", "q_vc", "q_ada", "q_importance", "q_lime", "q_shap", "q_mrmr",
        "q_kendall"}


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_no_cross_products_in_any_plan(spark):
    bad = {}
    for name, fn in E.queries().items():
        if name in SKIP:
            continue
        plan = _plan(fn(spark, SF))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad[name] = plan[:300]
    assert not bad, bad


def test_season_is_one_shuffle(spark):
    plan = _plan(E.queries()["q_season"](spark, SF))
    tree = plan.split("\n\n")[0]
    assert tree.count("Exchange") == 1
    assert "PushedFilters" in plan or "ReadSchema: struct<l_suppkey" in plan
