"""Graphs: building, checks, grouping, messages, life cycle and specifications."""

import pytest
from pyspark.sql import functions as F

from sampleweave.plans.graph import Graph
from sampleweave.sources import generators


def chain():
    g = Graph("chain")
    a = g.add("CountingSource", "source", n_samples_max=10)
    b = g.add("MultiplyConst", "twice", value=2.0)
    c = g.add("AddConst", "plus", value=1.0)
    g.connect(a, "out", b, "in")
    g.connect(b, "out", c, "in")
    return g


def values(frame):
    return [r["value"] for r in frame.orderBy("idx").collect()]


def test_chain(spark):
    g = chain()
    assert values(g.run(spark, "plus")) == [2 * v + 1 for v in range(1, 11)]
    assert g.sources() == ["source"] and g.adjacency()["twice"] == ["plus"]
    again = Graph.loaded(g.saved())
    assert values(again.run(spark, "plus")) == values(g.run(spark, "plus"))
    pytest.importorskip("yaml")
    assert Graph.loaded(g.saved(yaml=True)).spec() == again.spec()


def test_checks():
    g = chain()
    for bad in (("plus", "out", "twice", "in"), ("plus", "nothing", "twice", "in"), ("plus", "out", "twice", "nothing")):
        with pytest.raises(ValueError):
            g.connect(*bad)
    with pytest.raises(ValueError):
        g.add("NoSuchBlock")
    g.remove_edge("source", "out", "twice", "in")
    with pytest.raises(ValueError, match="cycle"):
        g.connect("plus", "out", "twice", "in")


def test_groups(spark):
    g = chain()
    g.group(["twice", "plus"], "inner")
    assert values(g.run(spark, "inner", "plus.out") if ("inner", "plus.out") in g.compile(spark) else g.flattened().run(spark, "plus")) == [2 * v + 1 for v in range(1, 11)]
    flat = g.flattened()
    assert set(flat.blocks) == {"source", "twice", "plus"} and values(flat.run(spark, "plus"))[0] == 3
    sub = Graph("sub")
    sub.add("AddConst", "x", value=5.0)
    sub.export("in", "x", "in")
    sub.export("out", "x", "out")
    outer = Graph()
    outer.add("CountingSource", "s", n_samples_max=2)
    outer.add(sub, "sub")
    outer.connect("s", "out", "sub", "in")
    assert values(outer.run(spark, "sub")) == [6, 7]
    assert values(sub.run(spark, "x", **{"in": generators.counting_source(spark, 1)})) == [6]


def test_messages_and_states(spark):
    g = chain()
    g.message("ReplaceBlock", name="plus", type="SubtractConst", settings={"value": 1.0})
    g.message("Settings", name="twice", settings={"value": 3.0})
    assert values(g.run(spark, "plus")) == [3 * v - 1 for v in range(1, 11)]
    b = g.blocks["twice"]
    b.store_defaults()
    b.presets["low"] = {"value": 0.5}
    b.activate("low")
    assert b.settings["value"] == 0.5
    b.reset_defaults()
    assert b.settings["value"] == 3.0
    b.go("INITIALISED")
    b.go("RUNNING")
    with pytest.raises(ValueError):
        b.go("PAUSED")
    g.message("RemoveBlock", name="plus")
    assert not [e for e in g.edges if "plus" in (e.source, e.target)]


def test_filter_block(spark):
    g = Graph()
    g.add("SignalGenerator", "tone", n=4000, sample_rate=1000.0, frequency=5.0)
    g.add("BasicFilter", "low", f_low=50.0, f_high=60.0, sample_rate=1000.0, decimate=4)
    g.connect("tone", "out", "low", "in")
    out = g.run(spark, "low")
    assert out.count() == 1000 and out.filter("idx > 500").agg(F.max("value")).first()[0] == pytest.approx(1.0, abs=0.02)
