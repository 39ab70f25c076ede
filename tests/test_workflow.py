"""Graphs, specs, runs, sinks."""

import time

import pytest

from quillon.plans import errors
from quillon.plans.dag import Dag, Node, Ports, Status
from quillon.plans.registry import Engine, normalise


class Sleep(Node):
    def __init__(self, seconds=0.0, fail=False, inputs=()):
        self.seconds, self.fail, self.inputs = seconds, fail, inputs

    def ports(self):
        return Ports(inputs=dict.fromkeys(self.inputs))

    def execute(self, inputs):
        time.sleep(self.seconds)
        if self.fail:
            raise ValueError("broken")
        return {0: type("Frame", (), {"schema": type("S", (), {"simpleString": lambda self: "none"})()})()}


def test_graph_errors():
    d = Dag()
    for n in "abc":
        d.add_node(n, Sleep(inputs=(0, 1)))
    with pytest.raises(errors.DuplicateNode):
        d.add_node("a", Sleep())
    d.add_edge("a", "b")
    d.add_edge("b", "c")
    with pytest.raises(errors.PortOverconnected):
        d.add_edge("c", "b")
    with pytest.raises(errors.CycleError) as e:
        d.add_edge("c", "a")
    assert str(e.value).count("→") == 3
    with pytest.raises(errors.CycleError):
        d.add_edge("a", "a")
    with pytest.raises(errors.EngineError):
        d.delete_node("a")
    with pytest.raises(errors.PortDisconnected):
        d.validate()
    assert d.topo_order() == ["a", "b", "c"] and '"a" -> "b"' in d.dot()
    d.delete_edge("a", "b")
    with pytest.raises(errors.EdgeNotFound):
        d.delete_edge("a", "b")


def test_failure_skips_descendants_only():
    d = Dag()
    d.add_node("bad", Sleep(fail=True))
    d.add_node("after", Sleep(inputs=(0,)))
    d.add_node("good", Sleep())
    d.add_edge("bad", "after")
    r = d.run()
    assert [r.nodes[n].status for n in ("bad", "after", "good")] == [Status.FAILED, Status.SKIPPED, Status.SUCCESS]
    assert r.nodes["after"].skipped_because == "bad" and r.nodes["bad"].error["kind"] == "node_error"
    assert r.summary() == {"total": 3, "succeeded": 1, "failed": 1, "skipped": 1}


def test_concurrency():
    d = Dag()
    for i in range(4):
        d.add_node(str(i), Sleep(0.1))
    began = time.monotonic()
    d.run(max_concurrency=4)
    wide = time.monotonic() - began
    began = time.monotonic()
    d.run(max_concurrency=1)
    assert wide < 0.35 <= time.monotonic() - began


def test_spec_repair():
    schema = {"type": "object", "properties": {"xs": {"type": "array", "items": {"type": "integer"}}, "f": {"type": "boolean"}, "o": {"anyOf": [{"type": "number"}, {"type": "null"}]}}}
    assert normalise({"xs": {"item": "3"}, "f": "true", "o": None}, schema) == {"xs": [3], "f": True, "o": None}
    assert normalise({"xs": {"1": "b", "0": "4"}, "o": "2.5"}, schema) == {"xs": [4, "b"], "o": 2.5}


def test_csv_sql_sink(spark, tmp_path):
    (tmp_path / "in.csv").write_text("region,charges\nn,1\ns,2\nn,4\n")
    e = Engine(spark)
    e.add("src", "source", {"path": str(tmp_path / "in.csv")})
    e.add("q", "sql", '{"sql_query": "SELECT region, sum(charges) AS total FROM port_0 GROUP BY region ORDER BY region"}')
    e.add("out", "sink_file", {"path": str(tmp_path / "out.csv"), "format": "csv"})
    e.connect("src", "q")
    e.connect("q", "out")
    r = e.run(count_rows=True)
    assert r.summary()["succeeded"] == 3 and r.nodes["q"].output_rows[0] == 2
    assert (tmp_path / "out.csv").read_text() == "region,total\nn,5\ns,2\n"
    page = e.page("q", offset=1)
    assert page["data"] == [{"region": "s", "total": 2}] and page["total_rows"] == 2
    e.update("out", "sink_file", {"path": str(tmp_path / "out.csv"), "format": "csv", "mode": "append"})
    e.run()
    assert len((tmp_path / "out.csv").read_text().splitlines()) == 5


def test_unknown_kind_and_spec(spark):
    e = Engine(spark)
    with pytest.raises(errors.UnknownNode):
        e.add("x", "nothing")
    with pytest.raises(errors.SpecError):
        e.add("x", "sql", {})


def test_long_chains_and_locked_runs(spark):
    import threading
    import time

    from quillon.plans.dag import Dag, Node, Ports, Status
    from quillon.plans.errors import CycleError

    class Step(Node):
        kind = "step"

        def ports(self):
            return Ports(inputs=None)

        def execute(self, inputs):
            time.sleep(0.0005)
            return {0: None}

    d = Dag()
    for k in range(1500):
        d.nodes[f"n{k}"], d.status[f"n{k}"] = Step(), Status.PENDING
    d.edges = [(f"n{k}", f"n{k + 1}", 0, 0) for k in range(1499)]
    assert d.topo_order() == [f"n{k}" for k in range(1500)]
    with pytest.raises(CycleError, match="n0 → n1 → n2"):
        d.add_edge("n1499", "n0")
    Step.execute = lambda self, inputs: time.sleep(0.0005) or {}
    d.edges = [("n0", "n1", 0, 0)]
    d.nodes = {k: d.nodes[k] for k in ("n0", "n1", "n2")}
    began = threading.Event()

    class Slow(Step):
        def execute(self, inputs):
            began.set()
            time.sleep(0.5)
            return {}

    d.nodes["n2"] = Slow()
    changed = []
    other = threading.Thread(target=lambda: (began.wait(), d.add_node("late", Step()), changed.append(time.monotonic())))
    other.start()
    report = d.run()
    done = time.monotonic()
    other.join()
    assert "late" not in report.nodes and changed[0] >= done - 0.01 and "late" in d.nodes
