"""An event-sourced workspace: facts, findings, an agenda, activity and stars are folds of one append-only journal."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.operators import folds
from lensframe.operators.semantic import chunk
from lensframe.session import cut

SCHEMA = "seq bigint, kind string, key string, status string, text string, detail string, author string"

#: How much of each part a perception shows, and the severities of findings.
TALK, FINDINGS, ACTIVITY, ACTIONS, OPEN_ITEMS, TAIL, STEPS = 40, 8, 8, 10, 12, 60, 30
SEVERITIES = ("info", "warn", "error")


class Workspace:
    """The journal is a DataFrame; every view of it is a query, so a copy that is read again gives the same state."""

    def __init__(self, spark: SparkSession, journal: DataFrame | None = None):
        self.spark = spark
        self.journal = journal if journal is not None else spark.createDataFrame([], SCHEMA)
        self._since = 0  # appends since the journal was written
        self._next = int(self.journal.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0])

    def append(self, rows: list[tuple[str, str, str, str, str, str]]) -> None:
        """Events as (kind, key, status, text, detail, author), numbered in order."""
        if not rows:
            return
        new = self.spark.createDataFrame([(self._next + i, *r) for i, r in enumerate(rows)], SCHEMA)
        self._next += len(rows)
        self._since += 1
        self.journal = self.journal.unionByName(new)
        if self._since >= 64:
            self.journal, self._since = cut(self.journal), 0

    def of(self, kind: str) -> DataFrame:
        return self.journal.where(F.col("kind") == kind)

    # ---------------------------------------------------------------- facts, findings, agenda

    def record_profile(self, field: str, value: str) -> None:
        self.append([("profile", field, "", value, "", "")])

    def profile(self) -> DataFrame:
        """``key, text``: the last value of each fact."""
        return folds.latest(self.of("profile"), "key", F.col("seq"), "text")

    def add_finding(self, severity: str, text: str, source: str = "") -> bool:
        """A finding, unless its text is known already; an unknown severity is the mildest."""
        if not self.of("finding").where(F.col("text") == text).isEmpty():
            return False
        self.append([("finding", f"f{self._next}", "open", text, json.dumps({"severity": severity if severity in SEVERITIES else SEVERITIES[0], "source": source}), "")])
        return True

    def resolve_finding(self, key: str) -> None:
        state = self.findings().where(F.col("key") == key).first()
        if state is not None and state["status"] != "resolved":
            self.append([("finding", key, "resolved", "", "", "")])

    def findings(self) -> DataFrame:
        """``key, status, text, detail``: the state of each finding."""
        return folds.agenda(self.of("finding"), "key", "seq", "status", ["text", "detail"])

    def finding_counts(self) -> DataFrame:
        return folds.open_and_resolved(self.of("finding"), "key", "seq", "status")

    def plan(self, items: list[str]) -> None:
        self.append([("agenda", f"t{self._next + i}", "open", t, "", "") for i, t in enumerate(items)])

    def agenda(self) -> DataFrame:
        """``key, status, text, detail, arrived`` of each task."""
        return folds.agenda(self.of("agenda"), "key", "seq", "status", ["text", "detail"])

    def ordered_agenda(self) -> DataFrame:
        return folds.plan_order(self.agenda(), "status")

    def find_task(self, said: str) -> str | None:
        """A task by its key, else the first one that is not done and whose text holds what was said."""
        tasks = self.agenda()
        hit: Column = (F.col("key") == said) | (F.col("status") != "done") & F.lower("text").contains(said.lower())
        r = tasks.where(hit).orderBy(F.col("key") != said, "arrived").first()
        return r["key"] if r else None

    def set_task(self, said: str, status: str) -> bool:
        """A new status; nothing for a task that is unknown or has it already."""
        key = self.find_task(said)
        if key is None or not self.agenda().where((F.col("key") == key) & (F.col("status") == status)).isEmpty():
            return False
        self.append([("agenda", key, status, "", "", "")])
        return True

    def work(self, said: str) -> bool:
        return self.set_task(said, "active")

    def done(self, said: str) -> bool:
        return self.set_task(said, "done")

    def agenda_head(self) -> DataFrame:
        """The first open task."""
        return self.agenda().where("status <> 'done'").orderBy("arrived").limit(1)

    # ---------------------------------------------------------------- activity, stars, recents, steps

    def act(self, kind: str, subject: str, detail: str = "", task: str = "") -> None:
        self.append([("activity", task, kind, subject, detail, "")])

    def activity(self, most: int = TAIL) -> DataFrame:
        """The last activities; one that repeats the one before is not shown."""
        return folds.drop_repeats(self.of("activity"), ["seq"], ["status", "text", "detail"], None, most)

    def star(self, target: str) -> None:
        self.append([("star", target, "", "", "", "")])

    def stars(self) -> DataFrame:
        return folds.stars(self.of("star"), "key", F.col("seq")).orderBy("since")

    def open(self, target: str) -> None:
        self.append([("open", target, "", "", "", "")])

    def recents(self, most: int = 8) -> DataFrame:
        return folds.recents(self.of("open"), "key", F.col("seq"), most)

    def steps(self) -> DataFrame:
        """Each task's activity told shortly."""
        a = self.of("activity").where("status <> 'flagged'").select(F.col("key").alias("task"), "seq", F.col("status").alias("kind"), F.col("text").alias("subject"), "detail")
        return folds.story(a, "task", "seq")

    def recent_steps(self, most: int = STEPS) -> DataFrame:
        return self.steps().orderBy(F.desc("seq")).limit(most)

    def task_story(self, key: str) -> DataFrame:
        """The steps of a task without notes that only say its title again."""
        title = self.agenda().where(F.col("key") == key).select(F.col("key").alias("task"), F.col("text").alias("title"))
        told = self.steps().join(F.broadcast(title), "task")
        return told.where(~((F.col("kind") == "note") & folds.restates(F.col("title"), F.col("subject")))).drop("title").orderBy("seq")

    def step_pages(self) -> DataFrame:
        """A page per step: how many tries it took, and the task that it is part of."""
        return folds.step_page(self.steps(), self.agenda().select(F.col("key").alias("task"), "text"))

    def finding_page(self, key: str) -> DataFrame:
        """A finding with its severity and the source it is about."""
        return self.findings().where(F.col("key") == key).select("key", "status", "text", F.get_json_object("detail", "$.severity").alias("severity"), F.get_json_object("detail", "$.source").alias("source"))

    def say(self, author: str, text: str) -> None:
        self.append([("talk", "", "", text, "", author)])

    def perception(self) -> dict[str, DataFrame]:
        """What there is to know at a glance: small tables of the folded state."""
        last = lambda df, n: df.orderBy(F.desc("seq")).limit(n)
        return {
            "profile": self.profile(),
            "talk": last(self.of("talk"), TALK).select("seq", "author", "text"),
            "findings": self.findings().where("status = 'open'").orderBy(F.desc("arrived")).limit(FINDINGS),
            "activity": last(self.activity(), ACTIVITY).select("seq", "status", "text"),
            "actions": last(self.of("activity"), ACTIONS).select("seq", "status", "text"),
            "agenda": self.agenda().where("status <> 'done'").orderBy("arrived").limit(OPEN_ITEMS),
        }

    # ---------------------------------------------------------------- merging with others

    def merge(self, other: DataFrame, origin: str, known: int) -> DataFrame:
        """Another's events (``seq, ...``) that go on without a gap from what is known of it, appended in order; the ones taken."""
        taken = folds.contiguous(other.withColumn("o", F.lit(origin)), "o", "seq", known).drop("o")
        rows = [(r["kind"], r["key"], r["status"], r["text"], r["detail"], r["author"]) for r in taken.orderBy("seq").toLocalIterator()]
        self.append(rows)
        return taken


def document_source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A document's pages (``file, page, text, via``) and its chunks, ready for vectors."""
    from lensframe.sources.binary_formats import read_document

    pages = read_document(spark, path)
    return pages, chunk(pages.withColumn("at", F.concat_ws("#", "file", F.col("page").cast("string"))), "at", "text")


def find_document(name: str, roots: list[str]) -> str | None:
    """A file by its basename below the given folders; names that lead elsewhere find nothing."""
    base = os.path.basename(name)
    if not base or base != name:
        return None
    for root in roots:
        for d, _, files in os.walk(root):
            if base in files:
                return os.path.join(d, base)
    return None


def projects(spark: SparkSession, root: str) -> DataFrame:
    """``name``: folders that hold a journal or a project file."""
    found = sorted({e.name for e in os.scandir(root) if e.is_dir() and any(os.path.exists(os.path.join(e.path, f)) for f in ("journal.jsonl", "project.json"))}) if os.path.isdir(root) else []
    return spark.createDataFrame([(n,) for n in found], "name string")
