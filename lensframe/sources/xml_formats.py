"""Drilling XML: plural containers of objects, logs with their data lines, and engineering exports, as rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from lensframe.sources.rows import UnreadableFile, parsed_rows, typed

#: Members that only describe the file, attributes that say nothing of the thing, and the deepest nesting read.
SKIPPED, DROPPED, DEEPEST = ("commonData", "customData", "documentInfo"), ("uom", "version"), 256


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attributes(e: ET.Element) -> dict[str, str]:
    return {_name(k): v for k, v in e.attrib.items() if _name(k) not in DROPPED and not k.startswith("xmlns")}


def _scalar(e: ET.Element) -> bool:
    return not len(e)


def _text(e: ET.Element) -> str | None:
    return (e.text or "").strip() or None


def _depth(e: ET.Element, most: int = DEEPEST) -> None:
    level = [e]
    for _ in range(most):
        level = [c for x in level for c in x]
        if not level:
            return
    raise UnreadableFile("nested too deep")


def _flat(e: ET.Element, prefix: str, out: dict, grain: str | None) -> None:
    """Scalars and attributes under dotted names; members of the row grain are left out."""
    for k, v in _attributes(e).items():
        out.setdefault(prefix + k, v)
    for c in e:
        n = _name(c.tag)
        if n in SKIPPED or (prefix == "" and n == grain):
            continue
        if _scalar(c):
            t = _text(c)
            if t is not None:
                out.setdefault(prefix + n, t)
        else:
            _flat(c, f"{prefix}{n}.", out, None)


def _grain(e: ET.Element) -> str | None:
    """The member with parts that occurs most often, twice at least; of equal ones the last."""
    seen = Counter(_name(c.tag) for c in e if not _scalar(c) and _name(c.tag) not in SKIPPED)
    best = None
    for n in seen:
        if seen[n] >= 2 and (best is None or seen[n] >= seen[best]):
            best = n
    return best


def objects(root: ET.Element) -> Iterator[dict]:
    """A row per member of the grain with its object's context (the member's own fields win), or a row per object."""
    for obj in root:
        if _name(obj.tag) in SKIPPED:
            continue
        grain = _grain(obj)
        context: dict = {}
        _flat(obj, "", context, grain)
        if grain is None:
            yield context
            continue
        for member in obj:
            if _name(member.tag) == grain:
                own: dict = {}
                _flat(member, "", own, None)
                yield context | own


def logs(root: ET.Element) -> Iterator[dict]:
    """A row per data line of each log: ``well`` and a column per curve."""
    for log in root:
        if _name(log.tag) != "log":
            continue
        by: dict[str, str | None] = {}
        curves: list[str] = []
        lines: list[str] = []
        for e in log.iter():
            n = _name(e.tag)
            if n == "nameWell" and "well" not in by:
                by["well"] = _text(e)
            elif n == "logCurveInfo":
                m = next((c for c in e if _name(c.tag) == "mnemonic"), None)
                curves.append((_text(m) if m is not None else None) or e.attrib.get("uid") or f"curve{len(curves) + 1}")
            elif n == "mnemonicList" and not curves:
                curves = [x.strip() for x in (_text(e) or "").split(",")]
            elif n == "data" and _scalar(e):
                lines.append(_text(e) or "")
        for line in lines:
            cells = line.split(",")
            yield {"well": by.get("well")} | {c: (cells[i].strip() or None) if i < len(cells) else None for i, c in enumerate(curves)}


def export(root: ET.Element) -> Iterator[dict]:
    """A row per element with attributes only, in document order: ``family`` is its name."""
    for e in root.iter():
        if e is not root and e.attrib and _scalar(e) and not _text(e) or e is not root and e.attrib and _name(e.tag).startswith("CD_"):
            yield {"family": _name(e.tag)} | _attributes(e)


def _is_export(root: ET.Element) -> bool:
    leaves = [e for e in root.iter() if e is not root]
    plain = [e for e in leaves if e.attrib and not _text(e)]
    return len(leaves) >= 3 and len(plain) >= 0.8 * len(leaves)


def xml_rows(content: bytes, path: str) -> Iterator[dict]:
    """The rows of a drilling XML file, by what its root is."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        raise UnreadableFile(f"{path}: {e}") from e
    _depth(root)
    rows: list[dict]
    if _name(root.tag) == "logs" or any(_name(c.tag) == "log" for c in root):
        rows = list(logs(root)) or list(objects(root))
    elif _is_export(root):
        rows = list(export(root))
    else:
        rows = list(objects(root))
    rows = [r for r in rows if r]
    if not rows:
        raise UnreadableFile(f"{path}: no rows")
    yield from rows


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    return typed(parsed_rows(spark, path, xml_rows))
