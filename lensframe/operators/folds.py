"""Folds of append-only events: latest per key, toggles, runs, agendas, stories, and merging by origin."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, seq: Column, value: str) -> DataFrame:
    """``key, value``: the last value of each key."""
    return df.groupBy(key).agg(F.max_by(value, seq).alias(value))


def agenda(df: DataFrame, key: str, seq: str, status: str, carried: list[str]) -> DataFrame:
    """The last status per item; blank carried fields keep the last that said anything."""
    keep = [F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(seq))).alias(c) for c in carried]
    return df.groupBy(key).agg(F.max_by(status, seq).alias(status), *keep, F.min(seq).alias("arrived"))


def plan_order(items: DataFrame, status: str) -> DataFrame:
    """Active items first, then open, then done; by arrival within."""
    rank = F.when(F.col(status) == "active", 0).when(F.col(status) == "open", 1).otherwise(2)
    return items.orderBy(rank, "arrived")


def open_and_resolved(df: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    last = latest(df, key, F.col(seq), state)
    return last.agg(F.count_if(F.col(state) == "open").alias("open"), F.count_if(F.col(state) == "resolved").alias("resolved"))


def new_findings(known: DataFrame, found: DataFrame, severities: tuple[str, ...] = ("info", "warn", "error"), fallback: str = "info") -> DataFrame:
    """Findings whose text is not known yet, once each, with a severity of the list."""
    once = found.groupBy("text").agg(F.min_by("severity", "seq").alias("severity"), F.min("seq").alias("seq"))
    allowed = F.when(F.col("severity").isin(*severities), F.col("severity")).otherwise(fallback)
    return once.join(known.select("text").distinct(), "text", "left_anti").withColumn("severity", allowed)


def drop_repeats(df: DataFrame, order: list[str], same: list[str], within: str | None = None, most: int | None = None) -> DataFrame:
    """Events without those that repeat the one before; the last ``most`` of each stream if asked."""
    w = (W.partitionBy(within) if within else W.partitionBy()).orderBy(*order)
    repeated = F.lit(True)
    for c in same:
        repeated = repeated & F.col(c).eqNullSafe(F.lag(c).over(w))
    kept = df.withColumn("__r", repeated & (F.row_number().over(w) > 1)).where("not __r").drop("__r")
    if most is None:
        return kept
    last = (W.partitionBy(within) if within else W.partitionBy()).orderBy(*(F.desc(o) for o in order))
    return kept.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= most).drop("__n")


def recents(df: DataFrame, target: str, seq: Column, most: int = 8) -> DataFrame:
    """``target, last``: the targets used last, each once."""
    return df.groupBy(target).agg(F.max(seq).alias("last")).orderBy(F.desc("last")).limit(most)


def stars(df: DataFrame, target: str, seq: Column) -> DataFrame:
    """``target, since``: targets toggled an odd number of times, by when they were toggled last."""
    return df.groupBy(target).agg(F.count("*").alias("n"), F.max(seq).alias("since")).where("n % 2 = 1").select(target, "since")


def story(df: DataFrame, task: str, seq: str) -> DataFrame:
    """``task, seq, kind, subject, detail, tries``: a task's steps told shortly.

    Failures of a subject collapse into one with their number; a later ``built`` of it takes them in as ``tries``. ``inspected`` and ``described`` keep the last per
    subject; exact repeats go. A task's steps are told in one place, as the tale needs their order.
    """
    schema = f"{task} {dict(df.dtypes)[task]}, seq bigint, kind string, subject string, detail string, tries int"

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[dict[str, Any]] = []
        failed: dict[str, int] = {}
        latest_of: dict[tuple[str, str], int] = {}
        seen: set[tuple] = set()
        for r in rows.sort_values(seq).itertuples(index=False):
            kind, subject, detail = getattr(r, "kind"), getattr(r, "subject"), getattr(r, "detail")
            exact = (kind, subject, detail)
            step = {task: getattr(r, task), "seq": getattr(r, seq), "kind": kind, "subject": subject, "detail": detail, "tries": 1}
            if kind == "failed":
                if subject in failed:
                    held = out[failed[subject]]
                    held.update(seq=step["seq"], detail=detail, tries=held["tries"] + 1)
                    continue
                failed[subject] = len(out)
            elif kind == "built" and subject in failed:
                at = failed.pop(subject)
                step["tries"] = out[at]["tries"] + 1
                out[at] = {}
            elif kind in ("inspected", "described"):
                at = latest_of.get((kind, subject))
                if at is not None:
                    out[at] = {}
                latest_of[kind, subject] = len(out)
            elif exact in seen:
                continue
            seen.add(exact)
            out.append(step)
        return pd.DataFrame([x for x in out if x], columns=[task, "seq", "kind", "subject", "detail", "tries"])

    return df.groupBy(task).applyInPandas(tell, schema)


def restates(title: Column, note: Column, share: float = 0.8) -> Column:
    """Whether a note only says a title again: most of the title's words are words of the note, or beginnings of them or the other way."""
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\w]+", " ")), " "), lambda w: w != "")
    t, n = words(title), words(note)
    hit = F.filter(t, lambda w: F.exists(n, lambda x: (x == w) | x.startswith(w) | w.startswith(x)))
    return (F.size(t) > 0) & (F.size(hit) >= share * F.size(t))


def have_map(df: DataFrame, origin: str, seq: str) -> DataFrame:
    """``origin, next``: the sequence number each origin goes on with."""
    return df.groupBy(origin).agg((F.max(seq) + 1).alias("next"))


def events_from(df: DataFrame, origin: str, seq: str, name: object, start: int) -> DataFrame:
    """An origin's events from a sequence number on."""
    return df.where((F.col(origin) == name) & (F.col(seq) >= start))


def contiguous(df: DataFrame, origin: str, seq: str, start: int = 0) -> DataFrame:
    """Of each origin the events that go on without a gap from ``start``; repeats count once."""
    once = df.where(F.col(seq) >= start).dropDuplicates([origin, seq])
    w = W.partitionBy(origin).orderBy(seq)
    return once.withColumn("__n", F.row_number().over(w) - 1 + start).where(F.col(seq) == F.col("__n")).drop("__n")


def lineage(raw: DataFrame, derived: DataFrame, seq: str = "seq", source: str = "input_seq") -> DataFrame:
    """Derived rows with the input they come from."""
    return derived.join(raw.select(F.col(seq).alias(source), *(F.col(c).alias(f"input_{c}") for c in raw.columns if c != seq)), source, "left")


def replay(journal: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """``seq, kind, key, status, text``: the events of a journal (``k, p, o, s, line``), numbered as they stand in it; what else it holds (effects) is not run again.

    A line counts once for its origin and number. The folds over the result give the state that was.
    """
    events = journal.where(F.col("k") == "ev").groupBy("o", "s").agg(F.min("line").alias("seq"), F.min_by("p", "line").alias("p"))
    field = lambda n: F.get_json_object("p", f"$.{n}").alias(n)
    out = events.select("seq", field("kind"), field("key"), field("status"), field("text"))
    return out.where(F.col("kind").isin(*kinds)) if kinds else out


#: The arguments that make two calls of a tool the same one; of two names joined by "or" the first that is filled. Names in capitals count without case.
CALL_KEYS = {
    "show": ("view", "source or name", "series"), "inspect": ("source",), "make_lens": ("NAME",), "describe": ("source",), "annotate": ("source", "field"), "read_source": ("path",),
    "read_document": ("name or path",), "run_skill": ("skill", "command"), "search": ("QUERY",), "record_profile": ("field",),
}


def call_key(call: Column) -> Column:
    """What a tool call (JSON of ``tool`` and ``args``) is told apart by: tool and target; a text that is none, or of another tool, by itself."""
    tool = F.get_json_object(call, "$.tool")

    def argument(names: str) -> Column:
        got = [F.get_json_object(call, f"$.args.{n.lower()}") for n in names.split(" or ")]
        found = F.coalesce(*(F.when(g != "", g) for g in got), F.lit(""))
        return F.lower(found) if names.isupper() else found

    out = call
    for name, parts in CALL_KEYS.items():
        out = F.when(tool == name, F.concat_ws(":", F.lit(name), *(argument(p) for p in parts))).otherwise(out)
    return out


def once_per_turn(calls: DataFrame, turn: str, seq: str, call: str) -> DataFrame:
    """Tool calls without those that ask the same again within a turn: the first of each stays."""
    keyed = calls.withColumn("__key", call_key(F.col(call)))
    first = keyed.groupBy(turn, "__key").agg(F.min_by(F.struct(*calls.columns), seq).alias("x"))
    return first.select("x.*")


def step_page(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """``task, seq, kind, subject, detail, note, part_of``: a page per step of ``story``: how many tries it took, and the task that it is part of (``task, text``)."""
    n = F.col("tries")
    built = F.when(n > 1, F.concat(F.lit("succeeded after "), (n - 1).cast("string"), F.when(n == 2, " failed attempt").otherwise(" failed attempts")))
    failed = F.when(n > 1, F.concat(F.lit("tried "), n.cast("string"), F.lit(" times; the latest error:")))
    noted = steps.withColumn("note", F.when(F.col("kind") == "built", built).when(F.col("kind") == "failed", failed))
    return noted.join(tasks.select("task", F.col("text").alias("part_of")), "task", "left").select("task", "seq", "kind", "subject", "detail", "note", "part_of")
