"""A graph of lenses: full plans, incremental steps, and edits that travel back to their sources."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensframe.operators import zset
from lensframe.operators.lenses import Lens
from lensframe.session import cut


@dataclass
class Node:
    name: str
    lens: Lens | None
    inputs: list[str]
    external: bool = False
    observers: list = field(default_factory=list)


class Graph:
    """Nodes in the order of their making, which is an order of their dependence.

    ``build`` gives the plan of a node over whole sources. ``submit`` takes a change of a source and maintains every state that
    it touches; a node whose change nets to nothing stops the change there. Changes are written tables, and a state is its last written table
    with the changes since, written again when they are ``COMPACT``: plans do not grow with the number of changes.
    """

    COMPACT = 16
    #: Rows of a change up to which it is handed to all tasks, so that the state that it meets is not shuffled.
    SMALL = 100_000

    def __init__(self) -> None:
        self.nodes: dict[str, Node] = {}
        self._base: dict[str, DataFrame] = {}
        self._since: dict[str, list[DataFrame]] = {}
        self.log: list[dict[str, Any]] = []
        self.outbox: list[tuple[str, DataFrame, str]] = []
        self.revision = 0
        self._expected: dict[str, int] = {}
        #: How often each node was computed by a change, and which of them gave a change: what incremental work is measured by.
        self.computed: dict[str, int] = {}
        self._written: set[str] = set()  # nodes whose base has rows

    def source(self, name: str, empty: DataFrame, external: bool = False) -> str:
        """A source with its schema (``empty`` has no rows); an external one belongs to an adapter."""
        self.nodes[name] = Node(name, None, [], external)
        self._start(name, empty.withColumn(zset.WEIGHT, F.lit(0).cast("bigint")))
        return name

    def apply(self, name: str, lens: Lens, *inputs: str) -> str:
        if len(inputs) != lens.arity:
            raise ValueError(f"{type(lens).__name__} takes {lens.arity} inputs, not {len(inputs)}")
        missing = [i for i in inputs if i not in self.nodes]
        if missing:
            raise ValueError(f"no such node: {missing}")
        self.nodes[name] = Node(name, lens, list(inputs))
        self._start(name, lens.forward(*(self._base[i] for i in inputs)))
        kept = lens.memory(self._base[inputs[0]])
        if kept is not None:
            self._start(self._memory(name), kept)
        return name

    @staticmethod
    def _memory(name: str) -> str:
        return f"{name} memory"

    def observe(self, name: str, fn) -> None:
        self.nodes[name].observers.append(fn)

    def build(self, name: str, sources: dict[str, DataFrame]) -> DataFrame:
        """The node's plan over whole sources (Z-sets), left to the optimizer."""
        node = self.nodes[name]
        if node.lens is None:
            return sources[name]
        return node.lens.forward(*(self.build(i, sources) for i in node.inputs))

    def expect_echo(self, key: str) -> None:
        """One later change with this idempotency key is the echo of an own write."""
        self._expected[key] = self._expected.get(key, 0) + 1

    def submit(self, name: str, delta: DataFrame, author: str = "", origin: str = "local", note: str = "", key: str | None = None) -> list[str]:
        """Applies a change of a source; the nodes that changed, in order. Empty changes and echoes do nothing."""
        if origin == "echo":
            return []
        if key is not None and self._expected.get(key):
            self._expected[key] -= 1
            return []
        delta = cut(zset.consolidate(delta))
        size = self._size(delta)
        if not size:
            return []
        self.revision += 1
        self.log.append({"seq": len(self.log), "revision": self.revision, "stream": name, "author": author, "origin": origin, "note": note, "delta": delta})
        changed, sizes = {name: self._handy(delta, size)}, {name: size}
        self._grow(name, delta)
        for n in self.nodes.values():
            if n.lens is None or not any(i in changed for i in n.inputs):
                continue
            if n.lens.needs_all and not all(self._since[i] or i in self._written for i in n.inputs):
                continue
            deltas = [changed.get(i) for i in n.inputs]
            kept = n.lens.memory(deltas[0]) if deltas[0] is not None else None
            if kept is not None:
                self._hold(self._memory(n.name), cut(kept))
            states = [self._sum(self._memory(n.name))] if kept is not None else [self._sum(i) for i in n.inputs]
            self.computed[n.name] = self.computed.get(n.name, 0) + 1
            # what is made row by row stays a short plan over a written change; all else is written
            out = n.lens.delta(deltas, states, self.state_of(n.name) if n.lens.uses_own else None)
            out = out if n.lens.rowwise else cut(out)
            size = sizes[n.inputs[0]] if n.lens.same_size else self._size(out)
            if not size:
                continue
            changed[n.name], sizes[n.name] = self._handy(out, size), size
            self._grow(n.name, out)
        return list(changed)

    def _size(self, delta: DataFrame) -> int:
        """The number of rows of a written change, or more than SMALL."""
        return delta.limit(self.SMALL + 1).count()

    def _handy(self, delta: DataFrame, size: int) -> DataFrame:
        """A change, marked for broadcast if it is small."""
        return F.broadcast(delta) if size <= self.SMALL else delta

    def _start(self, name: str, like: DataFrame) -> None:
        self._base[name] = like.sparkSession.createDataFrame([], like.schema)
        self._since[name] = []

    def _grow(self, name: str, delta: DataFrame) -> None:
        self._hold(name, delta)
        self._tell(name, delta)

    def _hold(self, name: str, delta: DataFrame) -> None:
        self._since[name].append(delta.select(*self._base[name].columns))
        if len(self._since[name]) >= self.COMPACT:
            self._base[name], self._since[name] = cut(self.state_of(name)), []
            self._written.add(name)

    def _sum(self, name: str) -> DataFrame:
        """A state as the sum of its changes, not consolidated."""
        return reduce(DataFrame.unionByName, self._since[name], self._base[name])

    def _tell(self, name: str, delta: DataFrame) -> None:
        for fn in self.nodes[name].observers:
            fn(delta)

    def push_backward(self, name: str, edit: DataFrame, author: str = "", note: str = "") -> None:
        """An edit of a node's rows as changes of the sources it comes from: own sources take it at once, external ones by the outbox."""
        node = self.nodes[name]
        if node.lens is None:
            if node.external:
                self.outbox.append((name, cut(edit), note))
            else:
                self.submit(name, edit, author=author, note=note)
            return
        for i, part in zip(node.inputs, node.lens.backward(edit, [self.state_of(x) for x in node.inputs])):
            part = zset.consolidate(part)
            if not part.isEmpty():
                self.push_backward(i, part, author, note)

    def drain_outbox(self) -> list[tuple[str, DataFrame, str]]:
        out, self.outbox = self.outbox, []
        return out

    def state_of(self, name: str) -> DataFrame:
        """What a node holds now: the last written state with the changes since, consolidated once."""
        if not self._since[name]:
            return self._base[name]
        return zset.consolidate(self._sum(name))

    def blame(self, name: str) -> list[dict[str, Any]]:
        """The changes of a stream in order, with who made them."""
        return [{k: e[k] for k in ("seq", "revision", "author", "origin", "note")} for e in self.log if e["stream"] == name]


def milestone(customers: DataFrame, orders: DataFrame, least: float, offset: float = 2.0) -> tuple[Graph, str]:
    """The first loop: calibrated readings above a threshold, joined with what they belong to."""
    from lensframe.operators.lenses import Calibrate, Filter, Join

    g = Graph()
    g.source("assets", customers)
    g.source("readings", orders, external=True)
    g.apply("calibrated", Calibrate("temp", offset), "readings")
    g.apply("warm", Filter(F.col("temp") >= least), "calibrated")
    g.apply("joined", Join("id", "asset", ["name"], ["temp"]), "assets", "warm")
    return g, "joined"
