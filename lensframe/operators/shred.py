"""Deeply nested records as related flat tables, by adjacency-table shredding.

Every object and scalar of a record becomes a node row (record, node, parent, label, ordinal, path, scalar). Object nodes are joined with their scalar
children and pivoted into entity tables: in one aggregation over a stored adjacency table (``entities``), or, since a record's nodes are made in
one task anyway, right there without another shuffle (``shred_entities``). ``related_tables`` gives all tables of a collection of records.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a child may be wrapped to say what it is, and the member that holds members of their own.
WRAPPERS = ("Elem", "Text")

NODE_SCHEMA = T.StructType(
    [
        T.StructField("tree_key", T.StringType()),
        T.StructField("node_no", T.IntegerType()),
        T.StructField("parent_no", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("scalar", T.StringType()),
        T.StructField("is_object", T.BooleanType()),
    ]
)


def _depth_beyond(text: str, most: int) -> bool:
    """Whether brackets nest deeper than ``most``, judged outside of strings."""
    depth = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', text, re.S):
        c = m.group()
        if c in "[{":
            depth += 1
            if depth > most:
                return True
        elif c in "]}":
            depth -= 1
    return False


def _decode(text: str) -> object:
    """The value of a JSON text; a text that is JSON of a text is decoded again. Raises ValueError."""
    value: object = text
    while isinstance(value, str):
        if len(value) > 20_000 and _depth_beyond(value, 20_000):
            return _decode_deep(value)
        try:
            value = json.loads(value)
        except RecursionError:
            return _decode_deep(value)
    return value


def _decode_deep(text: str) -> object:
    """JSON without recursion, for nesting beyond what the standard reader takes."""
    scan, n, i = json.JSONDecoder().raw_decode, len(text), 0
    blank = " \t\n\r"
    stack: list[list] = []  # of [container, pending key or None, state]
    result: list[object] = []

    def put(value: object) -> None:
        if not stack:
            result.append(value)
            return
        box, key, _ = stack[-1]
        if isinstance(box, dict):
            box[key] = value
        else:
            box.append(value)
        stack[-1][2] = "after"

    while True:
        while i < n and text[i] in blank:
            i += 1
        if not stack and result:
            if i < n:
                raise ValueError("text after the value")
            return result[0]
        if i >= n:
            raise ValueError("it ends too early")
        c = text[i]
        if stack:
            box, _, state = stack[-1]
            close = "}" if isinstance(box, dict) else "]"
            if c == close and state in ("open", "after"):
                stack.pop()
                put(box)
                i += 1
                continue
            if state == "after":
                if c != ",":
                    raise ValueError("a comma is missing")
                stack[-1][2] = "next"
                i += 1
                continue
            if close == "}" and state in ("open", "next"):
                if c != '"':
                    raise ValueError("a member's name is missing")
                key, i = scan(text, i)
                while i < n and text[i] in blank:
                    i += 1
                if i >= n or text[i] != ":":
                    raise ValueError("a colon is missing")
                stack[-1][1:] = [key, "value"]
                i += 1
                continue
        if c in "[{":
            stack.append([{} if c == "{" else [], None, "open"])
            i += 1
        else:
            value, i = scan(text, i)
            put(value)


def _scalar(value: object) -> str:
    if value is True or value is False:
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value)


def _order(obj: dict, last: Sequence[str]) -> Iterator[tuple[str, object]]:
    """Members with those that hold members of their own at the end, whatever order the text has."""
    for k, v in obj.items():
        if k not in last:
            yield k, v
    for k in last:
        if k in obj:
            yield k, obj[k]


def _flat(items: list) -> Iterator[tuple[int, str, object]]:
    """What a list holds, lists in it too: running number, places in the lists ("2.1" is the first of the second), and item. Nulls have places."""
    number = 0
    stack = [(str(k), x) for k, x in zip(range(len(items), 0, -1), reversed(items))]
    while stack:
        path, x = stack.pop()
        if isinstance(x, list):
            stack.extend((f"{path}.{k}", y) for k, y in zip(range(len(x), 0, -1), reversed(x)))
        else:
            number += 1
            yield number, path, x


def nodes_of(value: object, child_members: Sequence[str] = ("children",), pair_members: Sequence[str] = ("attrs",)) -> Iterator[tuple[int, int, str, int, str, str | None, bool]]:
    """``(node_no, parent_no, label, ordinal, path, scalar, is_object)`` of a decoded record, objects in document order.

    Objects are numbered from 1, a holder before what it holds. A scalar carries its holder's number as parent and no number of its
    own (0). A list is no node: what it holds, in lists within it too, gets the list's label, a running number as ordinal and its places as path. Members
    named in ``pair_members`` hold named scalars, as an object or as a list of pairs; they become scalars labelled ``member.name``. A wrapped child
    (``{"Elem": {...}}``, ``{"Text": "..."}``) stands for what it wraps. A null has no node.
    """
    count = 0
    top = list(_flat(value)) if isinstance(value, list) else [(1, "1", value)]
    stack: list[tuple[object, int, str, int, str]] = [(x, 0, "", k, path) for k, path, x in reversed(top)]
    while stack:
        item, parent, label, ordinal, path = stack.pop()
        while isinstance(item, dict) and len(item) == 1 and next(iter(item)) in WRAPPERS:
            item = next(iter(item.values()))
        if item is None:
            continue
        if isinstance(item, list):
            stack.extend((x, parent, label, k, f"{path}.{p}") for k, p, x in reversed(list(_flat(item))))
        elif isinstance(item, dict):
            count += 1
            me = count
            yield me, parent, label, ordinal, path, None, True
            later: list[tuple[object, int, str, int, str]] = []
            for k, v in _order(item, child_members):
                if k in pair_members and _pairs(v) is not None:
                    for n, (name, x) in enumerate(_pairs(v), 1):
                        yield 0, me, f"{k}.{name}", n, str(n), None if x is None else _scalar(x), False
                elif isinstance(v, list):
                    later.extend((x, me, k, n, p) for n, p, x in _flat(v))
                elif isinstance(v, dict):
                    later.append((v, me, k, 1, "1"))
                elif v is not None:
                    yield 0, me, k, 1, "1", _scalar(v), False
            stack.extend(reversed(later))
        else:
            yield 0, parent, label, ordinal, path, _scalar(item), False


def _pairs(value: object) -> list[tuple] | None:
    """The named scalars of an object of scalars or a list of pairs; None for anything else."""
    if isinstance(value, dict):
        return list(value.items()) if not any(isinstance(x, (dict, list)) for x in value.values()) else None
    if isinstance(value, list) and all(isinstance(p, list) and len(p) == 2 and isinstance(p[0], str) and not isinstance(p[1], (dict, list)) for p in value):
        return [tuple(p) for p in value]
    return None


def shred(df: DataFrame, tree: str, keep: Iterable[str]) -> DataFrame:
    """The adjacency table of the JSON texts in ``tree``: ``keep`` columns, then tree_key, node_no, parent_no, label, ordinal, path, scalar, is_object.

    ``tree_key`` tells different texts of one ``keep`` key apart and makes equal ones the same. A text that is null, empty, not complete
    JSON, or no object or list gives no row. A narrow operation: one record's nodes are made in one task, in document order.
    """
    keep = list(keep)
    clash = {f.name for f in NODE_SCHEMA} & set(keep)
    if clash:
        raise ValueError(f"kept columns clash with the node table's: {sorted(clash)}")
    schema = T.StructType([*(df.schema[c] for c in keep), *NODE_SCHEMA.fields])
    source = df.where(F.col(tree).isNotNull()).select(*keep, F.col(tree).alias("__tree"))
    names = [*keep, *(f.name for f in NODE_SCHEMA)]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parents: list[int] = []
            rows: list[tuple] = []

            def flush() -> pa.RecordBatch:
                cols = list(zip(*rows))
                out = pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pa.array(parents, pa.int64())) for i in range(len(keep))), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names
                )
                parents.clear()
                rows.clear()
                return out

            for r, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                try:
                    value = _decode(text)
                except ValueError:
                    continue
                if not isinstance(value, (dict, list)):
                    continue
                key = hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
                for node in nodes_of(value):
                    parents.append(r)
                    rows.append((key, *node))
                    if len(rows) >= 50_000:
                        yield flush()
            if rows:
                yield flush()

    return source.mapInArrow(run, schema)


def shred_entities(df: DataFrame, tree: str, keep: Iterable[str], labels: dict[str, str], holder: str = "children") -> DataFrame:
    """``keep, node_no, parent_no`` and a column per label: as ``entities`` of ``shred``, each record shredded, joined and pivoted in one task.

    Equal records (``keep`` columns and text) count once: copies go before they are shredded, in the only shuffle.
    """
    keep = list(keep)
    clash = {"node_no", "parent_no", *labels.values()} & set(keep)
    if clash:
        raise ValueError(f"kept columns clash with the table's: {sorted(clash)}")
    ints = [T.StructField(c, T.IntegerType()) for c in ("node_no", "parent_no")]
    schema = T.StructType([*(df.schema[c] for c in keep), *ints, *(T.StructField(n, T.StringType()) for n in labels.values())])
    source = df.where(F.col(tree).isNotNull()).select(*keep, F.col(tree).alias("__tree")).dropDuplicates()
    wanted = {k: i for i, k in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records: list[int] = []  # of each object node
            nodes: list[tuple[int, int]] = []
            first: list[int] = []  # of each record: its first object
            cells: list[list[tuple[int, str | None]]] = [[] for _ in wanted]  # of each label: (object, scalar)

            def pivot() -> pa.RecordBatch:
                columns = []
                for held in cells:
                    at = np.fromiter((i for i, _ in held), np.int64, len(held))
                    place = np.full(len(nodes), len(held), np.int64)
                    place[at[::-1]] = np.arange(len(held))[::-1]  # of several the first
                    columns.append(pa.array([x for _, x in held] + [None], pa.string()).take(pa.array(place)))
                numbers = np.array(nodes, np.int32).reshape(-1, 2)
                kept = np.flatnonzero(numbers[:, 1] >= 0)
                out = [*(batch.column(i).take(pa.array(records, pa.int64())) for i in range(len(keep))), pa.array(numbers[:, 0]), pa.array(numbers[:, 1]), *columns]
                return pa.RecordBatch.from_arrays([c.take(pa.array(kept)) for c in out], names=schema.names)

            for r, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                try:
                    value = _decode(text)
                except ValueError:
                    continue
                if not isinstance(value, (dict, list)):
                    continue
                first.append(len(nodes))
                for node, parent, label, _, _, scalar, is_object in nodes_of(value):
                    if is_object:
                        records.append(r)
                        # objects elsewhere than in the holder keep their place, and go at the end
                        nodes.append((node, parent if label in ("", holder) else -1))
                    elif parent and label in wanted:
                        cells[wanted[label]].append((first[-1] + parent - 1, scalar))
                if len(nodes) >= 50_000:
                    yield pivot()
                    for held in (records, nodes, first, *cells):
                        held.clear()
            if nodes:
                yield pivot()

    return source.mapInArrow(run, schema)


def entities(nodes: DataFrame, keys: Iterable[str], labels: dict[str, str], holder: str | None = "children") -> DataFrame:
    """One row per object node with its scalar children of the given labels: ``keys, node_no, parent_no`` and a column per label.

    ``labels`` maps a scalar's label to a column name. Object nodes and scalars meet under the object's number, so the join and the
    pivot are one aggregation whose partial step runs where the record was read. Equal records (same keys and text) count once.
    Objects held elsewhere than in ``holder`` (or at the root) are left out; None keeps all. Of a label that repeats in an object the first is shown: ``values`` has all.
    """
    held = F.lit(True) if holder is None else F.col("label").isin("", holder)
    wanted = nodes.where(F.col("is_object") & held | ~F.col("is_object") & F.col("label").isin(*labels))
    owner = F.when(F.col("is_object"), F.col("node_no")).otherwise(F.col("parent_no")).alias("node_no")
    pivoted = wanted.groupBy(*keys, "tree_key", owner).agg(
        F.max(F.when(F.col("is_object"), F.col("parent_no"))).alias("parent_no"),
        *(F.min_by(F.when(F.col("label") == k, F.col("scalar")), F.when(F.col("label") == k, F.col("ordinal"))).alias(name) for k, name in labels.items()),
    )
    return pivoted.where(F.col("parent_no").isNotNull())


def attributes(nodes: DataFrame, keys: Iterable[str], member: str = "attrs") -> DataFrame:
    """``keys, tree_key, node_no, attr_no, attr_name, attr_value``: the named scalars of each object node, equal records once."""
    at = len(member) + 2
    return (
        nodes.where(~F.col("is_object") & F.col("label").startswith(member + "."))
        .select(*keys, "tree_key", F.col("parent_no").alias("node_no"), F.col("ordinal").alias("attr_no"), F.expr(f"substring(label, {at})").alias("attr_name"), F.col("scalar").alias("attr_value"))
        .dropDuplicates([*keys, "tree_key", "node_no", "attr_no"])
    )


def values(nodes: DataFrame, keys: Iterable[str], label: str) -> DataFrame:
    """``keys, tree_key, node_no, ordinal, path, value``: every scalar of a label under the object that holds it, equal records once. ``node_no`` 0 is the record itself."""
    chosen = nodes.where(~F.col("is_object") & (F.col("label") == label))
    return chosen.select(*keys, "tree_key", F.col("parent_no").alias("node_no"), "ordinal", "path", F.col("scalar").alias("value")).dropDuplicates([*keys, "tree_key", "node_no", "ordinal"])


def texts(nodes: DataFrame, keys: Iterable[str], holder: str = "children", blank: bool = False) -> DataFrame:
    """``keys, tree_key, node_no, child_no, text``: the text children of each object node; blank ones only if asked for."""
    chosen = values(nodes.where("parent_no > 0"), keys, holder)
    if not blank:
        chosen = chosen.where(F.col("value").rlike(r"\S"))
    return chosen.select(*keys, "tree_key", "node_no", F.col("ordinal").alias("child_no"), F.col("value").alias("text"))


def related_tables(nodes: DataFrame, keys: Iterable[str]) -> dict[str, DataFrame]:
    """All tables of a collection of records: one per label of objects, with a column per scalar that no such object has twice, and one per scalar that some has
    (``label/scalar``). Every row has its keys, tree_key, its number or its holder's, and its ordinal and path there; nothing of the records is left out.

    ``nodes`` is read several times: store it. What is collected is one row per label.
    """
    keys = list(keys)
    once = nodes.dropDuplicates([*keys, "tree_key", "node_no", "parent_no", "label", "ordinal"])
    objects, scalars = once.where("is_object"), once.where("not is_object")
    owner = objects.select(*keys, "tree_key", F.col("node_no").alias("parent_no"), F.col("label").alias("of"))
    owned = scalars.join(owner, [*keys, "tree_key", "parent_no"], "left").withColumn("of", F.coalesce("of", F.lit("")))
    most = owned.groupBy("of", "label", *keys, "tree_key", "parent_no").count().groupBy("of", "label").agg(F.max("count").alias("most")).collect()
    names = sorted({r[0] for r in objects.select("label").distinct().collect()} | {r["of"] for r in most})
    out: dict[str, DataFrame] = {}
    for name in names:
        single = [r["label"] for r in sorted(most, key=lambda r: r["label"]) if r["of"] == name and r["most"] == 1]
        cells = owned.where(F.col("of") == name)
        pivoted = cells.where(F.col("label").isin(*single)).groupBy(*keys, "tree_key", F.col("parent_no").alias("node_no")).agg(*(F.first(F.when(F.col("label") == c, F.col("scalar")), ignorenulls=True).alias(c) for c in single)) if single else None
        table = objects.where(F.col("label") == name).select(*keys, "tree_key", "node_no", "parent_no", "ordinal", "path")
        out[name] = table.join(pivoted, [*keys, "tree_key", "node_no"], "left") if pivoted is not None else table
        for r in most:
            if r["of"] == name and r["most"] > 1:
                out[f"{name}/{r['label']}"] = cells.where(F.col("label") == r["label"]).select(*keys, "tree_key", F.col("parent_no").alias("node_no"), "ordinal", "path", F.col("scalar").alias("value"))
    return out
