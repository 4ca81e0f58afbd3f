"""The catalog: mounted tables, authored lenses, their claims and lineage."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.functions.scalars import canon_name, slug_name
from lensframe.operators import profile

#: How far derivations are followed.
CHAIN_MOST = 12


class EmptyLens(ValueError):
    """A lens that gives no rows is refused."""


@dataclass
class Source:
    name: str
    df: DataFrame
    residence: str = "mounted"
    locator: str = ""
    title: str = ""
    description: str = ""
    refresh: str = "live"
    origin: str = ""
    parent: str | None = None
    code: str = ""
    version: int = 0
    extra: dict = field(default_factory=dict)


def resolve_field(df: DataFrame, asked: str, titles: dict[str, str] | None = None) -> str | None:
    """A column by its name, by its letters and digits, or by a title that someone gave it."""
    if asked in df.columns:
        return asked
    want = canon_name(asked)
    by = {}
    for c in df.columns:
        by.setdefault(canon_name(c), c)
    if want in by:
        return by[want]
    return next((c for c, t in (titles or {}).items() if canon_name(t) == want and c in df.columns), None)


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sources: dict[str, Source] = {}
        self._claims: list[tuple[str, str, str, str, int, str]] = []

    # ---------------------------------------------------------------- sources

    def register(self, name: str, df: DataFrame, **about: object) -> Source:
        """A table under a name; a temp view of the same name is made or replaced."""
        s = Source(name, df, **about)  # type: ignore[arg-type]
        self.sources[name] = s
        df.createOrReplaceTempView(self.view_name(name))
        return s

    @staticmethod
    def view_name(name: str) -> str:
        return slug_name(name).replace("-", "_") if not name.startswith("lens:") else "lens_" + slug_name(name[5:]).replace("-", "_")

    def mount(self, path: str, name: str | None = None, refresh: str = "live", **about: object) -> Source:
        """A file or directory as a table, named by its basename; mounting a name again adds rows to it."""
        from lensframe.sources.dispatch import read_path

        name = name or slug_name(os.path.splitext(os.path.basename(path.rstrip("/")))[0])
        df = read_path(self.spark, path)
        if name in self.sources and self.sources[name].residence == "mounted":
            df = self.sources[name].df.unionByName(df, allowMissingColumns=True)
        return self.register(name, df, locator=path, refresh=refresh, **about)

    def mount_manifest(self, manifest: str) -> list[str]:
        """Mounts what a manifest (JSON list of name, path, ...) names; paths that are missing are passed over."""
        out = []
        base = os.path.dirname(manifest)
        with open(manifest) as f:
            for e in json.load(f):
                path = e["path"] if os.path.isabs(e["path"]) else os.path.join(base, e["path"])
                if not os.path.exists(path):
                    continue
                keys = ("residence", "refresh", "title", "description", "origin")
                s = self.mount(path, e.get("name"), **{k: e[k] for k in keys if k in e})
                out.append(s.name)
        return out

    def table(self, name: str) -> DataFrame:
        found = self.resolve(name)
        if found is None:
            raise KeyError(f"no such source: {name}")
        return self.sources[found].df

    def resolve(self, name: str) -> str | None:
        """A source by its name, as a lens, by slug, or by title."""
        slug = slug_name(name)
        for guess in (name, f"lens:{slug}", slug):
            if guess in self.sources:
                return guess
        by_title = {slug_name(s.title): n for n, s in self.sources.items() if s.title}
        return by_title.get(slug) or next((n for n in self.sources if slug_name(n) == slug), None)

    def line(self, name: str) -> str:
        s = self.sources[name]
        return " · ".join(x for x in (f"{s.df.count()} rows", f"{len(s.df.columns)} columns", s.residence, s.origin) if x)

    # ---------------------------------------------------------------- lenses

    def make_lens(self, name: str, source: str, code: Callable[[DataFrame, Callable[[str], DataFrame]], DataFrame] | str, description: str = "", materialize: bool = False) -> Source:
        """A derived source ``lens:<slug>``: a function of (rows, table) or SQL over ``rows`` and other sources' views.

        It must give rows. It stays fresh with its source unless ``materialize``; making it again is a new version.
        """
        origin = self.resolve(source)
        if origin is None:
            raise KeyError(f"no such source: {source}")
        rows = self.sources[origin].df.distinct()
        if isinstance(code, str):
            rows.createOrReplaceTempView("rows")
            out = self.spark.sql(code)
        else:
            out = code(rows, self.table)
        if not isinstance(out, DataFrame):
            raise TypeError("a lens gives a table")
        if materialize:
            from lensframe.session import cut

            out = cut(out)
        if out.isEmpty():
            raise EmptyLens(f"{name} gives no rows")
        key = f"lens:{slug_name(name)}"
        version = self.sources[key].version + 1 if key in self.sources else 1
        return self.register(key, out, residence="derived", parent=origin, code=code if isinstance(code, str) else getattr(code, "__name__", "function"), title=name, description=description, version=version)

    def chain(self, name: str) -> list[str]:
        """A source and what it derives from, at most twelve steps."""
        out = [name]
        while len(out) <= CHAIN_MOST and self.sources[out[-1]].parent in self.sources and self.sources[out[-1]].parent not in out:
            out.append(self.sources[out[-1]].parent)  # type: ignore[arg-type]
        return out

    # ---------------------------------------------------------------- claims

    def claim(self, source: str, field_: str, fact: str, value: str, author: str = "") -> None:
        self._claims.append((source, field_, fact, value, len(self._claims), author))

    def annotate(self, source: str, field_: str, title: str = "", description: str = "", ref: str = "", author: str = "") -> None:
        """What someone says a column means; it overrides what was said before."""
        found = self.resolve(source)
        if found is None:
            raise KeyError(f"no such source: {source}")
        column = resolve_field(self.sources[found].df, field_, self.titles(found))
        if column is None:
            raise KeyError(f"no such field: {field_}")
        for fact, v in (("title", title), ("description", description), ("ref", ref)):
            if v:
                self.claim(found, column, fact, v, author)

    def describe(self, source: str, title: str = "", description: str = "", origin: str = "") -> None:
        s = self.sources[self.resolve(source) or source]
        s.title, s.description, s.origin = title or s.title, description or s.description, origin or s.origin

    def profile(self, name: str) -> None:
        """Adds the claims of a source's profile."""
        for r in profile.claims(name, self.sources[name].df).orderBy("seq").collect():
            self.claim(name, r["field"], r["fact"], r["value"], "profile")

    def link(self) -> DataFrame:
        """Finds references among all mounted sources and claims them."""
        found = profile.links({n: s.df for n, s in self.sources.items() if s.residence != "derived"})
        for r in found.collect():  # a row per referring column
            self.claim(r["source"], r["field"], r["kind"], f"{r['target']}.{r['target_field']}", "profile")
        return found

    def claims(self) -> DataFrame:
        return self.spark.createDataFrame(self._claims, "source string, field string, fact string, value string, seq bigint, author string")

    def facts(self, name: str) -> dict[str, dict[str, str]]:
        """Folded claims of a source, by field and fact."""
        out: dict[str, dict[str, str]] = {}
        for s, f, fact, v, _, _ in self._claims:
            if s == name and v not in (None, ""):
                out.setdefault(f, {})[fact] = v
        return out

    def titles(self, name: str) -> dict[str, str]:
        return {f: x["title"] for f, x in self.facts(name).items() if "title" in x}

    def semantics(self, name: str, field_: str) -> dict[str, str]:
        """Title and description of a column, from the nearest source of its derivation that has them."""
        for s in self.chain(name):
            got = {k: v for k, v in self.facts(s).get(field_, {}).items() if k in ("title", "description")}
            if got:
                return got
        return {}

    def columns(self) -> DataFrame:
        return self.spark.createDataFrame([(n, c) for n, s in self.sources.items() for c in s.df.columns], "source string, field string")

    def gaps(self) -> DataFrame:
        return profile.schema_gaps(self.columns(), profile.fold_claims(self.claims()))

    def first_gap(self, most: int = 8) -> tuple[str, list[str], int] | None:
        """The first mounted source with untitled columns, some of them, and how many."""
        for n, s in self.sources.items():
            if s.residence == "derived" or n == "documents":
                continue
            bare = [c for c in s.df.columns if not self.semantics(n, c).get("title")]
            if bare:
                return n, bare[:most], len(bare)
        return None

    def inspect(self, name: str) -> dict[str, DataFrame]:
        df = self.table(name)
        return {"ranges": profile.inspect_ranges(df), "gaps": profile.inspect_gaps(df), "duplicates": profile.inspect_duplicates(df)}

    def map(self) -> tuple[DataFrame, DataFrame]:
        counts = self.spark.createDataFrame([(n, s.df.count()) for n, s in self.sources.items()], "source string, rows bigint")
        refs = [(s, v.partition(".")[0]) for s in self.sources for f in self.facts(s).values() for k, v in f.items() if k in ("ref", "refs")]
        derived = [(n, s.parent) for n, s in self.sources.items() if s.parent]
        return profile.schema_map(counts, self.spark.createDataFrame(refs, "source string, target string"), self.spark.createDataFrame(derived, "source string, parent string"))


def dashboard(catalog: Catalog, body: str) -> list[tuple[dict, DataFrame]]:
    """The views of a dashboard's blocks, in order."""
    from lensframe.operators import views

    out = []
    for block in views.parse_dashboard(body):
        options = {k: v for k, v in block.items() if k not in ("view", "source", "title")}
        df = catalog.table(block["source"])
        for k in ("field", "lane", "x", "y", "z", "start", "end", "lon", "lat"):
            if isinstance(options.get(k), str):
                options[k] = resolve_field(df, options[k], catalog.titles(catalog.resolve(block["source"]) or "")) or options[k]
        out.append((block, views.show(block["view"], df, **options)))
    return out


def refresh_of(policies: list[str]) -> str:
    """The policy of a dashboard: live if any part is, else the shortest interval, else a snapshot; what is unknown is live."""
    seconds = []
    for p in policies:
        if p == "snapshot":
            continue
        if p.startswith("interval"):
            digits = "".join(c for c in p if c.isdigit())
            seconds.append(int(digits or 0))
            continue
        return "live"
    return f"interval {min(seconds)}" if seconds else "snapshot"


def definitions(df: DataFrame) -> DataFrame:
    """``hash, kind, source``: definitions by content; what differs in white space alone is the same one."""
    from lensframe.functions.scalars import content_hash

    flat = F.trim(F.regexp_replace("source", r"\s+", " "))
    return df.select(content_hash(F.col("kind"), flat, F.coalesce(F.col("deps"), F.lit(""))).alias("hash"), "kind", flat.alias("source"), "name").groupBy("hash", "kind", "source").agg(F.array_sort(F.collect_set("name")).alias("names"))


class Definitions:
    """Definitions by content under names: ``define`` gives the hash, ``bind_name`` makes a name mean it, ``publish`` does both, ``resolve`` and ``get`` lead back.

    What differs in white space alone is one definition; a name bound again means the new one, and every holder of the old hash keeps the old one.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._defined: dict[str, tuple[str, str, tuple[str, ...]]] = {}
        self._names: dict[str, str] = {}

    def define(self, kind: str, source: str, deps: tuple[str, ...] = ()) -> str:
        import hashlib

        flat = " ".join(source.split())
        parts = [kind, flat, *deps]
        key = hashlib.sha256("".join(f"{len(p.encode())}:{p}" for p in parts).encode()).hexdigest()[:16]
        self._defined[key] = (kind, flat, tuple(deps))
        return key

    def bind_name(self, name: str, key: str) -> None:
        if key not in self._defined:
            raise KeyError(f"no such definition: {key}")
        self._names[name] = key

    def publish(self, name: str, kind: str, source: str, deps: tuple[str, ...] = ()) -> str:
        key = self.define(kind, source, deps)
        self.bind_name(name, key)
        return key

    def resolve(self, name: str) -> str | None:
        return self._names.get(name)

    def get(self, key: str) -> tuple[str, str, tuple[str, ...]] | None:
        return self._defined.get(key)

    def table(self) -> DataFrame:
        """``name, hash, kind, source``: every name with what it means."""
        return self.spark.createDataFrame([(n, k, *self._defined[k][:2]) for n, k in self._names.items()], "name string, hash string, kind string, source string")
