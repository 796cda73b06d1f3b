"""Loops of linear blocks, in one operator and in graphs, against a loop over samples; expressions that feed back."""

import numpy as np
import pytest

from sampleweave.functions import expressions
from sampleweave.operators import feedback, recursive
from sampleweave.operators.feedback import Transfer
from sampleweave.plans.graph import Graph


def stream(spark, xs):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(xs)], "stream_id string, idx long, value double")


def values(frame):
    return [r["value"] for r in frame.orderBy("idx").collect()]


def test_delayed_sum(spark):
    ones = stream(spark, [1.0] * 6)
    out, tap = feedback.feedback_merge([ones], Transfer.delay(2), tap=True)
    assert values(out) == [1, 1, 1, 2, 2, 2]
    assert values(tap) == [0, 0, 1, 1, 1, 2]
    with pytest.raises(ValueError, match="delay"):
        Transfer().closed()


def test_graph_with_two_loops(spark):
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=(2, 90))
    g = Graph("loops")
    g.add("Add3", "sum")
    g.add("fir_filter", "front", b=[1.0, 0.5])
    g.add("Subtract", "difference")
    g.add("MultiplyConst", "slow", value=0.4)
    g.add("Delay", "late", n=2)
    g.export("u", "sum", "in0")
    g.export("v", "difference", "in1")
    for e in (("sum", "out", "front", "in"), ("front", "out", "difference", "in0"), ("difference", "out", "slow", "in"), ("slow", "out", "sum", "in1"), ("difference", "out", "late", "in"), ("late", "out", "sum", "in2")):
        g.connect(*e)
    a, d, z = np.zeros(90), np.zeros(90), np.zeros(90)
    for n in range(90):  # the edges slow-sum and late-sum close the loops: one sample each
        a[n] = u[n] + (0.4 * d[n - 1] if n else 0) + (d[n - 3] if n > 2 else 0) * 0.25
        d[n] = a[n] + (0.5 * a[n - 1] if n else 0) - v[n]
        z[n] = 0.4 * d[n]
    g.remove_edge("late", "out", "sum", "in2")
    g.add("MultiplyConst", "quarter", value=0.25)
    g.connect("late", "out", "quarter", "in")
    g.connect("quarter", "out", "sum", "in2")
    made = g.compile(spark, u=stream(spark, u), v=stream(spark, v))
    assert values(made["sum", "out"]) == pytest.approx(a)
    assert values(made["difference", "out"]) == pytest.approx(d)
    assert values(made["slow", "out"]) == pytest.approx(z)
    g.group(["slow", "late"], "inner")
    grouped = g.compile(spark, u=stream(spark, u), v=stream(spark, v))
    assert values(grouped["difference", "out"]) == pytest.approx(d)
    assert values(grouped["inner", "slow.out"]) == pytest.approx(z)
    g.replace("quarter", "AddConst", value=1.0)
    with pytest.raises(ValueError, match="not linear"):
        g.compile(spark, u=stream(spark, u), v=stream(spark, v))


@pytest.mark.parametrize("text", ["x + a*y", "if(x > 0, y + x, y * 0.5)", "(x - 2*y) / 4 + 1", "tanh(x + y)", "x / 0 + y", "max(y, x) % 3", "x > 0.5 and y < 1 ? x : -y"])
def test_recursive_expressions(spark, text):
    xs, want, y = np.random.default_rng(5).normal(size=150), [], 0.0
    for x in xs:
        y = float(expressions.computed(text, {"x": x, "y": y, "a": 0.3, "b": 0.0, "c": 0.0}))
        want.append(y)
    got = [np.nan if v is None else v for v in values(recursive.expression(stream(spark, xs), text, 0.3))]  # kernels give NaN back as null
    assert got == pytest.approx(want, nan_ok=True)


def test_weights():
    assert expressions.weighted("2*(x - y)/4 + sqrt(a)", {"a": 9.0}) == (0.5, -0.5, 3.0)
    assert expressions.weighted("x*y", {}) is None
    assert expressions.weighted("x/0 + y", {}) is None


def test_values_that_are_not_finite():
    x = np.arange(200.0)
    x[70] = np.nan
    out, _ = recursive.Recursion([1.0], [1.0, -0.5]).run(x)
    assert np.isfinite(out[:70]).all() and np.isnan(out[70:]).all()


def test_regression_edges(spark):
    found = recursive.schmitt_regression(stream(spark, [2, -2, -0.5, 0.5, 2, 0, -2]), 0.0, 1.0, 10.0).orderBy("idx").collect()
    assert [(r["idx"], r["edge"]) for r in found] == [(4, "RISING"), (6, "FALLING")]
    assert [r["trigger_offset"] for r in found] == pytest.approx([-1 - (2 / 3) / 1.25, -1.0])
    assert not recursive.schmitt_regression(stream(spark, [0, 2, -2]), 0.0, 1.0).count()
