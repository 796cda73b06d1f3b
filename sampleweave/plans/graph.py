"""Graphs of blocks: a Python layer that composes operators into one DataFrame plan per output.

Blocks are made by registered type names, ports are connected and checked when the graph is built, sub-graphs export ports,
and a graph is read from and written to a plain specification (JSON; YAML where that package is there). Spark plans
have no cycles: a cycle of linear blocks becomes the recursion that it stands for (operators.feedback), each edge that
closes a loop starting with one zero; any other cycle is an error unless one block holds it (recursive operators).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleweave.operators import elementwise, feedback, frequency, monitor, recursive, select, spectral, timing, window
from sampleweave.operators.design import fir_design, iir_design
from sampleweave.operators.feedback import Transfer
from sampleweave.sources import generators

Build = Callable[..., Any]
BLOCKS: dict[str, tuple[Build, tuple[str, ...], tuple[str, ...]]] = {}

#: The states of a block and the changes between them that are allowed.
STATES = {"IDLE": ("INITIALISED", "STOPPED"), "INITIALISED": ("RUNNING", "STOPPED"), "RUNNING": ("REQUESTED_PAUSE", "REQUESTED_STOP", "STOPPED"), "REQUESTED_PAUSE": ("PAUSED",), "PAUSED": ("RUNNING", "STOPPED"), "REQUESTED_STOP": ("STOPPED",), "STOPPED": ("INITIALISED",), "ERROR": ("INITIALISED",)}


def block(name: str, inputs: tuple[str, ...] = ("in",), outputs: tuple[str, ...] = ("out",)) -> Callable:
    """Registers build(spark, *inputs, **settings), which returns a DataFrame, or a dict of them by output port."""

    def add(f: Build) -> Build:
        BLOCKS[name] = (f, inputs, outputs)
        return f

    return add


def plain(name: str, f: Build, inputs: tuple[str, ...] = ("in",)) -> None:
    block(name, inputs)(lambda spark, *frames, **settings: f(*frames, **settings))


for op in ("add", "subtract", "multiply", "divide"):
    plain(f"{op.capitalize()}Const", lambda s, value=1.0, op=op: elementwise.with_constant(s, op, value))
    for ports in range(2, 33):
        plain(op.capitalize() + ("" if ports == 2 else str(ports)), lambda *s, op=op: elementwise.fold(s, op), tuple(f"in{i}" for i in range(ports)))
plain("Copy", lambda s: s)
plain("Head", lambda s, n_samples_max: select.head(s, n_samples_max))
plain("Decimator", lambda s, decim=1: select.decimate(s, decim))
plain("Convert", lambda s, to="float64", scale=None: s.withColumn("value", elementwise.converted(F.col("value"), to, scale)))
plain("Abs", lambda s: s.withColumn("value", F.abs("value")))
plain("RadiansToDegree", lambda s: s.withColumn("value", elementwise.degrees(F.col("value"))))
plain("DegreeToRadians", lambda s: s.withColumn("value", elementwise.radians(F.col("value"))))
plain("RealImagToComplex", elementwise.real_imag_to_complex)
plain("MagPhaseToComplex", elementwise.mag_phase_to_complex)
plain("ToRealImag", elementwise.to_real_imag)
plain("ToMagPhase", elementwise.to_mag_phase)
plain("ComplexToInterleaved", elementwise.complex_to_interleaved)
plain("InterleavedToComplex", elementwise.interleaved_to_complex)
plain("Rotator", elementwise.rotator)
plain("ExpressionSISO", lambda s, expr_string="a*x", param_a=1.0, param_b=0.0, param_c=0.0: recursive.expression(s, expr_string, param_a, param_b, param_c))
plain("ExpressionDISO", lambda x, y, expr_string="a*(x+y)", param_a=1.0, param_b=0.0, param_c=0.0: elementwise.expression_of_two(x, y, expr_string, param_a, param_b, param_c), ("in0", "in1"))
plain("fir_filter", lambda s, b: window.fir(s, b))
plain("iir_filter", lambda s, b, a: recursive.iir(s, b, a))
plain("SavitzkyGolayFilter", lambda s, window_size=11, poly_order=4, deriv_order=0, sample_rate=1.0, alignment="Centred": window.savitzky_golay(s, window_size, poly_order, deriv_order, sample_rate, alignment == "Causal"))
plain("SchmittTrigger", lambda s, offset=0.0, threshold=1.0, sample_rate=1.0: recursive.schmitt(s, offset, threshold, sample_rate=sample_rate))
plain("SchmittTriggerLinear", lambda s, offset=0.0, threshold=1.0, sample_rate=1.0: recursive.schmitt(s, offset, threshold, True, sample_rate))
plain("SchmittTriggerRegression", lambda s, offset=0.0, threshold=1.0, sample_rate=1.0: recursive.schmitt_regression(s, offset, threshold, sample_rate))
plain("FFT", lambda s, fftSize=1024, window="Hann", sample_rate=1.0, outputInDb=False, outputInDeg=False, unwrapPhase=False: spectral.fft(s, fftSize, window, sample_rate, outputInDb, outputInDeg, unwrapPhase))
plain("SvdDenoiser", lambda s, window_size=64, hop_fraction=0.25, **how: frequency.svd_denoiser(s, window_size, hop_fraction, **how))
plain("FrequencyEstimatorTimeDomain", frequency.time_domain)
plain("FrequencyEstimatorFrequencyDomain", frequency.frequency_domain)
plain("MovingAverage", lambda s, size: window.moving(s, "mean", size))
block("NullSource", ())(lambda spark, n: generators.null_source(spark, n))
block("ConstantSource", ())(lambda spark, n_samples_max, default_value=0.0: generators.constant_source(spark, n_samples_max, default_value))
block("CountingSource", ())(lambda spark, n_samples_max, default_value=0.0: generators.counting_source(spark, n_samples_max, default_value))
block("SignalGenerator", ())(lambda spark, n, signal_type="Sin", **how: generators.signal_generator(spark, n, signal_type, **how))
block("Table", ())(lambda spark, frame: frame)
block("NullSink", ("in",), ())(lambda spark, s: {})
plain("builtin_multiply", lambda s, factor=1.0: elementwise.with_constant(s, "multiply", factor))
plain("builtin_counter", lambda s: s)
plain("scale", lambda s, scale=1.0: elementwise.with_constant(s, "multiply", scale), ("original",))
plain("adder", lambda a, b: elementwise.fold((a, b), "add"), ("addend0", "addend1"))
block("duplicate", ("in",), ("out0", "out1"))(lambda spark, s: {"out0": s, "out1": s})
block("CountSource", ())(lambda spark, n_samples_max: generators.constant_source(spark, n_samples_max, 42.0))
plain("ExpectSink", monitor.expected, ("sink",))
plain("CountingSink", monitor.counted)
plain("TagMonitor", monitor.tag_monitor)
plain("TagSink", monitor.tag_sink, ("in", "tags"))
plain("VectorSink", lambda s, size=1024: monitor.vectors(s, size))
plain("SettingsChangeRecorder", monitor.settings_changes)
plain("SimCompute", lambda s, **timing: s)
plain("ErrorPropagatingFilter", lambda s, b, a: recursive.error_propagating(s, b, a))
plain("DriftCompensator", lambda s, estimated_rate, nominal_rate, mode="Linear", chunk=1024: timing.adaptively_resampled(s, estimated_rate, nominal_rate, chunk) if mode == "AdaptiveResampling" else timing.spliced(s, estimated_rate, nominal_rate, chunk, mode))


@block("BasicFilter")
def basic_filter(spark, s: DataFrame, filter_type: str = "IIR", filter_response: str = "LOWPASS", filter_order: int = 3, f_low: float = 0.1, f_high: float = 0.2, sample_rate: float = 1.0, decimate: int = 1, iir_design_method: str = "BUTTERWORTH", fir_design_method: str = "Kaiser") -> DataFrame:
    if filter_type == "IIR":
        out = recursive.iir(s, *iir_design(filter_response, filter_order, f_low, f_high, sample_rate, iir_design_method))
    else:
        out = window.fir(s, fir_design(filter_response, f_low, f_high, sample_rate, window=fir_design_method)[0].tolist())
    return select.decimate(out, decimate) if decimate > 1 else out


@block("Selector", ("in0", "in1"), ("out0", "out1"))
def selector(spark, a: DataFrame, b: DataFrame, map_in: list[int] = (0, 1), map_out: list[int] = (0, 1), sync_combined_ports: bool = True) -> dict[str, DataFrame]:
    made = select.selector([a, b], list(zip(map_in, map_out, strict=True)), sync_combined_ports)
    return {f"out{k}": v for k, v in made.items()}


plain("Delay", lambda s, n=1: Transfer.delay(n).applied(s))

#: What linear blocks of one output do to each of their inputs, by their settings.
LINEAR: dict[str, Callable[..., list[Transfer]]] = {
    "MultiplyConst": lambda value=1.0: [Transfer.of([value])],
    "DivideConst": lambda value=1.0: [Transfer.of([1 / value])],
    "Copy": lambda: [Transfer()],
    "Delay": lambda n=1: [Transfer.delay(n)],
    "fir_filter": lambda b: [Transfer.of(b)],
    "iir_filter": lambda b, a: [Transfer.of(b, a)],
}
for ports in range(2, 33):
    label = "" if ports == 2 else str(ports)
    LINEAR[f"Add{label}"] = lambda n=ports: [Transfer()] * n
    LINEAR[f"Subtract{label}"] = lambda n=ports: [Transfer(), *[Transfer.of([-1.0])] * (n - 1)]


#: The properties of a block.
PROPERTIES = ("Heartbeat", "Echo", "LifecycleState", "Settings", "StagedSettings", "MetaInformation", "UiConstraints", "StoreDefaults", "ResetDefaults", "ActiveContext", "SettingsCtx", "SettingsContexts")


@dataclass
class Block:
    name: str
    kind: str
    settings: dict[str, Any] = field(default_factory=dict)
    state: str = "IDLE"
    defaults: dict[str, Any] = field(default_factory=dict)
    presets: dict[str, dict[str, Any]] = field(default_factory=dict)
    meta: dict[str, Any] = field(default_factory=dict)
    graph: Graph | None = None
    staged: dict[str, Any] = field(default_factory=dict)
    context: str = ""
    subscribers: dict[str, list[str]] = field(default_factory=dict)

    def ports(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        if self.graph is not None:
            return tuple(self.graph.inputs), tuple(self.graph.outputs)
        return BLOCKS[self.kind][1:]

    def go(self, state: str) -> None:
        """A change of state that the life cycle allows; any state may end in ERROR."""
        if state != "ERROR" and state not in STATES[self.state]:
            raise ValueError(f"{self.name}: {self.state} does not lead to {state}")
        self.state = state

    def set(self, **settings: Any) -> None:
        self.settings |= settings

    def store_defaults(self) -> None:
        self.defaults = dict(self.settings)

    def reset_defaults(self) -> None:
        self.settings = dict(self.defaults)

    def activate(self, context: str) -> None:
        """The settings of a stored context over the present ones."""
        self.settings |= self.presets[context]
        self.context = context

    def apply_staged(self) -> None:
        """Settings that wait take effect: before the block is compiled, never in between."""
        self.settings |= self.staged
        self.staged = {}

    def property(self, name: str, action: str = "Get", **data: Any) -> Any:
        """The properties that a block answers to. Subscribing is possible for each of them; who did so is in subscribers."""
        if name not in PROPERTIES:
            raise ValueError(f"unknown property {name}")
        if action in ("Subscribe", "Unsubscribe"):
            held = self.subscribers.setdefault(name, [])
            client = data.get("client", "")
            if action == "Subscribe" and client not in held:
                held.append(client)
            elif action == "Unsubscribe" and client in held:
                held.remove(client)
            return list(held)
        if action not in ("Get", "Set"):
            raise ValueError(f"unknown action {action}")
        return (self.told if action == "Get" else self.changed)(name, data)

    def told(self, name: str, data: dict[str, Any]) -> Any:
        inputs, outputs = self.ports()
        answers = {
            "Heartbeat": lambda: {"name": self.name, "state": self.state},
            "Echo": lambda: {"name": self.name, **data},
            "LifecycleState": lambda: self.state,
            "Settings": lambda: dict(self.settings),
            "StagedSettings": lambda: dict(self.staged),
            "MetaInformation": lambda: {"kind": self.kind, "inputs": inputs, "outputs": outputs, **self.meta},
            "UiConstraints": lambda: dict(self.meta.get("ui", {})),
            "StoreDefaults": lambda: dict(self.defaults),
            "ResetDefaults": lambda: dict(self.defaults),
            "ActiveContext": lambda: self.context,
            "SettingsCtx": lambda: dict(self.presets[data["context"]]),
            "SettingsContexts": lambda: sorted(self.presets),
        }
        return answers[name]()

    def changed(self, name: str, data: dict[str, Any]) -> Any:
        if name in ("Settings", "StagedSettings"):
            self.staged |= data
            if name == "Settings" and self.state != "RUNNING":
                self.apply_staged()
        elif name == "LifecycleState":
            self.go(data["state"])
        elif name == "StoreDefaults":
            self.store_defaults()
        elif name == "ResetDefaults":
            self.reset_defaults()
        elif name == "ActiveContext":
            self.activate(data["context"])
        elif name == "SettingsCtx":
            if data.get("remove"):
                del self.presets[data["context"]]
            else:
                self.presets[data["context"]] = dict(data.get("settings", self.settings))
        elif name == "UiConstraints":
            self.meta["ui"] = dict(data)
        elif name != "Echo":
            raise ValueError(f"{name} cannot be set")
        return self.told(name, data)


@dataclass(frozen=True)
class Edge:
    source: str
    source_port: str
    target: str
    target_port: str


class Graph:
    def __init__(self, name: str = "graph"):
        self.name = name
        self.blocks: dict[str, Block] = {}
        self.edges: list[Edge] = []
        self.inputs: dict[str, tuple[str, str]] = {}
        self.outputs: dict[str, tuple[str, str]] = {}

    def add(self, kind: str | Graph, name: str | None = None, **settings: Any) -> Block:
        """A block of a registered type, or a graph as a block with its exported ports."""
        label = kind.name if isinstance(kind, Graph) else kind
        if not isinstance(kind, Graph) and kind not in BLOCKS:
            raise ValueError(f"unknown block type {kind}")
        name = name or f"{label}_{sum(b.kind == label for b in self.blocks.values())}"
        if name in self.blocks:
            raise ValueError(f"a block {name} exists")
        self.blocks[name] = Block(name, label, dict(settings), defaults=dict(settings), graph=kind if isinstance(kind, Graph) else None)
        return self.blocks[name]

    def connect(self, source: Block | str, source_port: str, target: Block | str, target_port: str) -> Edge:
        a, b = (x if isinstance(x, str) else x.name for x in (source, target))
        if source_port not in self.blocks[a].ports()[1]:
            raise ValueError(f"{a} has no output {source_port}")
        if target_port not in self.blocks[b].ports()[0]:
            raise ValueError(f"{b} has no input {target_port}")
        if any((e.target, e.target_port) == (b, target_port) for e in self.edges):
            raise ValueError(f"{b}.{target_port} is connected")
        edge = Edge(a, source_port, b, target_port)
        self.edges.append(edge)
        try:
            self.flattened().checked_loops()
        except ValueError:
            self.edges.pop()
            raise
        return edge

    def export(self, name: str, block_: Block | str, port: str) -> None:
        b = block_ if isinstance(block_, str) else block_.name
        inputs, outputs = self.blocks[b].ports()
        if port not in inputs + outputs:
            raise ValueError(f"{b} has no port {port}")
        (self.inputs if port in inputs else self.outputs)[name] = (b, port)

    def remove(self, name: str) -> None:
        del self.blocks[name]
        self.edges = [e for e in self.edges if name not in (e.source, e.target)]

    def remove_edge(self, source: str, source_port: str, target: str, target_port: str) -> None:
        self.edges.remove(Edge(source, source_port, target, target_port))

    def replace(self, name: str, kind: str, **settings: Any) -> Block:
        """Another type under the same name; its edges stay where its ports have the same names."""
        made = Block(name, kind, dict(settings), defaults=dict(settings))
        inputs, outputs = made.ports()
        self.blocks[name] = made
        self.edges = [e for e in self.edges if (e.source != name or e.source_port in outputs) and (e.target != name or e.target_port in inputs)]
        return made

    def group(self, names: list[str], name: str) -> Block:
        """Blocks as a sub-graph; edges across its border become exported ports."""
        inner = Graph(name)
        inner.blocks = {n: self.blocks[n] for n in names}
        inner.edges = [e for e in self.edges if e.source in inner.blocks and e.target in inner.blocks]
        rest, outer = [], []
        for e in self.edges:
            if e in inner.edges:
                continue
            if e.source in inner.blocks:
                port = f"{e.source}.{e.source_port}"
                inner.outputs[port] = (e.source, e.source_port)
                outer.append((name, port, e.target, e.target_port))
            elif e.target in inner.blocks:
                port = f"{e.target}.{e.target_port}"
                inner.inputs[port] = (e.target, e.target_port)
                outer.append((e.source, e.source_port, name, port))
            else:
                rest.append(e)
        for n in names:
            del self.blocks[n]
        self.edges = rest
        made = self.add(inner, name)
        for e in outer:
            self.connect(*e)
        return made

    def ungroup(self, name: str) -> None:
        inner = self.blocks[name].graph
        if inner is None:
            raise ValueError(f"{name} is no group")
        around = [e for e in self.edges if name in (e.source, e.target)]
        self.remove(name)
        self.blocks |= inner.blocks
        self.edges += inner.edges
        for e in around:
            source = inner.outputs[e.source_port] if e.source == name else (e.source, e.source_port)
            target = inner.inputs[e.target_port] if e.target == name else (e.target, e.target_port)
            self.edges.append(Edge(*source, *target))

    def flattened(self) -> Graph:
        out = Graph(self.name)
        out.blocks, out.edges = dict(self.blocks), list(self.edges)
        out.inputs, out.outputs = dict(self.inputs), dict(self.outputs)
        while groups := [n for n, b in out.blocks.items() if b.graph is not None]:
            out.ungroup(groups[0])
        return out

    def order(self) -> Iterator[str]:
        """Names so that every block follows its sources."""
        for names in self.components():
            if len(names) > 1 or any(e.source == e.target == names[0] for e in self.edges):
                raise ValueError(f"the graph has a cycle over {', '.join(names)}")
            yield names[0]

    def components(self) -> list[list[str]]:
        """Groups of names that cycles join (mostly of one name each), so that every group follows its sources."""
        reach = {n: self.reached(n) for n in self.blocks}
        groups: list[list[str]] = []
        for n in self.blocks:
            if not any(n in g for g in groups):
                groups.append([n, *(m for m in self.blocks if m != n and m in reach[n] and n in reach[m])])
        out: list[list[str]] = []
        while groups:
            ready = next(g for g in groups if not any(g[0] in reach[h[0]] for h in groups if h is not g))
            out.append(ready)
            groups.remove(ready)
        return out

    def reached(self, start: str) -> set[str]:
        seen, left = set(), [start]
        while left:
            for e in self.edges:
                if e.source == left[0] and e.target not in seen:
                    seen.add(e.target)
                    left.append(e.target)
            left.pop(0)
        return seen

    def closing(self) -> list[Edge]:
        """The edges that close loops, as a walk in depth meets them: from each block in the order of adding, along its edges in the order of connecting."""
        found: list[Edge] = []
        path: list[str] = []
        done: set[str] = set()

        def walk(name: str) -> None:
            path.append(name)
            for e in self.edges:
                if e.source == name and e.target in path:
                    found.append(e)
                elif e.source == name and e.target not in done:
                    walk(e.target)
            done.add(path.pop())

        for name in self.blocks:
            if name not in done:
                walk(name)
        return found

    def checked_loops(self) -> None:
        """An error for a cycle with a block that is not linear."""
        for names in self.components():
            if len(names) > 1 or any(e.source == e.target == names[0] for e in self.edges):
                other = [n for n in names if self.blocks[n].kind not in LINEAR]
                if other:
                    raise ValueError(f"the graph has a cycle through {', '.join(other)}, which is not linear; use one recursive block in its place")

    def resolved(self, name: str, port: str, outputs: bool = True) -> tuple[str, str]:
        """The inner block and port of a group's exported port."""
        inner = self.blocks[name].graph
        return (name, port) if inner is None else inner.resolved(*(inner.outputs if outputs else inner.inputs)[port], outputs)

    def sources(self) -> list[str]:
        return [n for n in self.blocks if not any(e.target == n for e in self.edges)]

    def adjacency(self) -> dict[str, list[str]]:
        return {n: [e.target for e in self.edges if e.source == n] for n in self.blocks}

    def compile(self, spark: SparkSession, **given: DataFrame) -> dict[tuple[str, str], DataFrame]:
        """The DataFrame of every output port. given: frames for exported inputs."""
        flat = self.flattened()
        flat.checked_loops()
        flat.inputs = {k: self.resolved(*v, outputs=False) for k, v in self.inputs.items()}
        made: dict[tuple[str, str], DataFrame] = {}
        for names in flat.components():
            made |= flat.loop(names, made, given) if flat.closes(names) else flat.one(spark, names[0], made, given)
        groups = [(n, port) for n, b in self.blocks.items() if b.graph is not None for port in b.graph.outputs]
        return made | {(n, port): made[self.resolved(n, port)] for n, port in groups}

    def closes(self, names: list[str]) -> bool:
        return any(e.source in names and e.target in names for e in self.edges)

    def fed(self, name: str, port: str, made: dict[tuple[str, str], DataFrame], given: dict[str, DataFrame]) -> DataFrame:
        edge = next((e for e in self.edges if (e.target, e.target_port) == (name, port)), None)
        if edge is not None:
            return made[edge.source, edge.source_port]
        outside = next((k for k, v in self.inputs.items() if v == (name, port)), None)
        if outside not in given:
            raise ValueError(f"{name}.{port} is not connected")
        return given[outside]

    def one(self, spark: SparkSession, name: str, made: dict[tuple[str, str], DataFrame], given: dict[str, DataFrame]) -> dict[tuple[str, str], DataFrame]:
        b = self.blocks[name]
        b.apply_staged()
        inputs, outputs = b.ports()
        found = BLOCKS[b.kind][0](spark, *(self.fed(name, port, made, given) for port in inputs), **b.settings)
        if isinstance(found, DataFrame):
            found = {outputs[0]: found}
        return {(name, port): frame for port, frame in found.items()}

    def loop(self, names: list[str], made: dict[tuple[str, str], DataFrame], given: dict[str, DataFrame]) -> dict[tuple[str, str], DataFrame]:
        """The outputs of linear blocks that cycles join: first as sums of what comes in and of what the closing edges bring, then without those."""
        closing = [e for e in self.closing() if e.source in names and e.target in names]
        frames: dict[Any, DataFrame] = {}
        at: dict[Any, feedback.Sum] = {}
        while len(at) < len(names):
            for n in names:
                before = {e.target_port: e for e in self.edges if e.target == n and e.source in names}
                if n in at or any(e not in closing and e.source not in at for e in before.values()):
                    continue
                parts = []
                for port, transfer in zip(self.blocks[n].ports()[0], LINEAR[self.blocks[n].kind](**self.blocks[n].settings), strict=True):
                    edge = before.get(port)
                    if edge is None:
                        frames[n, port] = self.fed(n, port, made, given)
                    source = {(n, port): Transfer()} if edge is None else {edge: Transfer.delay(1)} if edge in closing else at[edge.source]
                    parts.append(feedback.through(source, transfer))
                at[n] = feedback.added(parts)
        brought = {e: at[e.source] for e in closing}
        return {(n, "out"): feedback.summed(frames, s) for n, s in feedback.solved(brought, at).items()}

    def run(self, spark: SparkSession, name: str, port: str = "out", **given: DataFrame) -> DataFrame:
        return self.compile(spark, **given)[name, port]

    def message(self, command: str, **data: Any) -> Any:
        """The requests of a running scheduler as method calls."""
        if command == "EmplaceBlock":
            return self.add(data["type"], data.get("name"), **data.get("settings", {})).name
        if command == "RemoveBlock":
            return self.remove(data["name"])
        if command == "ReplaceBlock":
            return self.replace(data["name"], data["type"], **data.get("settings", {})).name
        if command == "EmplaceEdge":
            return self.connect(data["source"], data["source_port"], data["target"], data["target_port"])
        if command == "RemoveEdge":
            return self.remove_edge(data["source"], data["source_port"], data["target"], data["target_port"])
        if command == "GroupBlocks":
            return self.group(data["names"], data["name"]).name
        if command == "UngroupBlocks":
            return self.ungroup(data["name"])
        if command == "Settings":
            return self.blocks[data["name"]].set(**data["settings"])
        if command == "Property":
            return self.blocks[data["name"]].property(data["property"], data.get("action", "Get"), **data.get("data", {}))
        if command == "SchedulerInspect":
            return {"states": {n: b.state for n, b in self.blocks.items()}, "edges": len(self.edges), "sources": self.sources()}
        if command in ("GraphSpec", "Inspect"):
            return self.spec()
        raise ValueError(f"unknown command {command}")

    def spec(self) -> dict[str, Any]:
        blocks = [{"name": b.name, "id": b.kind, "parameters": b.settings, **({"graph": b.graph.spec()} if b.graph else {})} for b in self.blocks.values()]
        return {"name": self.name, "blocks": blocks, "connections": [[e.source, e.source_port, e.target, e.target_port] for e in self.edges], "inputs": self.inputs, "outputs": self.outputs}

    @classmethod
    def of_spec(cls, spec: dict[str, Any]) -> Graph:
        out = cls(spec.get("name", "graph"))
        for b in spec.get("blocks", []):
            out.add(cls.of_spec(b["graph"]) if "graph" in b else b["id"], b["name"], **(b.get("parameters") or {}))
        for c in spec.get("connections", []):
            out.connect(*c)
        out.inputs = {k: tuple(v) for k, v in (spec.get("inputs") or {}).items()}
        out.outputs = {k: tuple(v) for k, v in (spec.get("outputs") or {}).items()}
        return out

    def saved(self, yaml: bool = False) -> str:
        if not yaml:
            return json.dumps(self.spec(), indent=1)
        import yaml as package

        return package.safe_dump(json.loads(json.dumps(self.spec())), sort_keys=False)

    @classmethod
    def loaded(cls, text: str) -> Graph:
        try:
            return cls.of_spec(json.loads(text))
        except json.JSONDecodeError:
            import yaml as package

            return cls.of_spec(package.safe_load(text))
