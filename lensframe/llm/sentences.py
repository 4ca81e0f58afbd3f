"""Sentence boundaries across languages and scripts.

A pushdown automaton runs over each block of lines. Its stack holds the quotations and brackets that are open; a
terminator ends a unit only where the stack allows it. A trie of abbreviations is walked backwards from each
full stop. Lists, logs and tables are told from wrapped prose by the lines of their block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations that never end a sentence where something follows.
OPEN_ABBREVIATIONS = (
    "mr mrs ms dr prof st fig figs tab app ref rev cf vs approx ca incl max vol ad re temp avg circ drl eng eq pp pg ch est ext dia e.g i.e n.b viz resp"
    " kl nr f.eks bl.a dvs iht pga jf pkt mht ift evt inkl hhv tlf m.a.o"
    " bzw vgl abb gem lt evtl ggf zzgl ing sog kap abs hr fr z.b d.h u.a s.o s.u i.d.r"
    " env mm mme mlle p.ex éd réf art chap"
    " aprox núm sra dra sr pág cap uds ud p.ej"
    " рис табл напр стр им ул т.е см акад руб"
    " डॉ क्र श्री सं पृ"
    " น พ ค"
    " nos"
).split()
#: Abbreviations that never end a sentence before a number, and are words elsewhere.
NUMBER_ABBREVIATIONS = "no sec item par art p s т п č n".split()
#: Abbreviations that end a sentence where the next word begins one.
CLOSE_ABBREVIATIONS = "etc fm dept co jr al inc ltd corp a.m p.m u.s u.k u.s.a usw osv m.v mv г гг т.д т.п др etc. ff ass mfl m.fl pty bros".split()
#: Units written with a full stop; after a number they end a sentence where the next word begins one.
UNITS = "in min hrs hr h sec deg ft kn lbs lb yd mi gal bbl std tim stk ч мин сек".split()
#: Months that may follow an ordinal.
MONTHS = frozenset(
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec"
    " januar februar mars mai juni juli oktober desember märz dezember jänner"
    " enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
    " janvier février avril juin juillet août septembre octobre novembre décembre"
    " января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
)
#: Pairs that nest, and what a Thai clause that goes on begins with.
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "„": "“", "“": "”", "‹": "›", "‚": "‘"}
BRACKET_OPENERS = frozenset("([{（［【〔")
THAI_GOES_ON = ("ตาม", "และ", "เพราะ", "ก่อน", "แล้ว", "เป็น", "ถึง", "จาก", "เมตร", "น.", "เมื่อ", "ที่", "ซึ่ง", "โดย", "หรือ", "แต่", "กับ", "ด้วย", "ใน", "ของ", "ต่อ", "จน", "เพื่อ", "ว่า", "มี", "ไม่", "ให้", "ลิตร", "บาร์", "ชั่วโมง", "นาที", "วัน", "ดู")

TERMINATORS = ".!?…。！？｡।॥؟۔｡"
_WIDE = frozenset("。！？｡।॥")
_MARKER = re.compile(r"[^\S\n]*(?:[-*•‣▪◦–·]|\(?\d{1,3}[.)])[^\S\n]+(?=\S)")
_LOG_WORD = re.compile(r"[^\S\n]*\d{1,2}[.:]\d{2}(?::\d{2})?[^\S\n]+(\S+)")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_EVENT = re.compile("[" + re.escape(TERMINATORS + "".join(PAIRS) + "".join(PAIRS.values()) + '"') + "]")
_THAI = re.compile(r"[฀-๿]")


@lru_cache(1)
def _trie() -> dict:
    """Abbreviations written backwards; the value at "" is their class."""
    root: dict = {}
    for kind, words in (("number", NUMBER_ABBREVIATIONS), ("unit", UNITS), ("close", CLOSE_ABBREVIATIONS), ("open", OPEN_ABBREVIATIONS)):
        for w in words:
            at = root
            for c in reversed(w):
                at = at.setdefault(c, {})
            at[""] = "unit-or-number" if {at.get("", kind), kind} == {"number", "unit"} else kind
    return root


def _abbreviation(text: str, dot: int, begin: int) -> tuple[str | None, int]:
    """The class of the longest abbreviation that ends before the full stop at ``dot``, and where it begins.

    Blanks after inner full stops are passed over, so that "d. h." is found like "d.h.".
    """
    at, i, found, start = _trie(), dot - 1, None, dot
    while i >= begin:
        c = text[i].lower()
        if c in at:
            at = at[c]
            if "" in at and (i == begin or not (text[i - 1].isalnum() or text[i - 1] in "./’'")):
                found, start = at[""], i
            i -= 1
        elif c.isspace() and "." in at and i + 1 < dot:
            i -= 1
        elif c.isspace() and i > begin and text[i - 1] == "." and i + 1 < dot:
            i -= 1
        else:
            break
    return found, start


_NEXT_PART = re.compile(r"\s*([^\W\d_]{1,4})\.")


@lru_cache(1)
def _several() -> frozenset[str]:
    return frozenset(w for w in (*OPEN_ABBREVIATIONS, *CLOSE_ABBREVIATIONS) if "." in w)


@lru_cache(1)
def _first_parts() -> frozenset[str]:
    return frozenset(w.split(".")[0] for w in _several())


def _caps(word: str) -> bool:
    letters = [c for c in word if c.isalpha()]
    return len(letters) > 1 and all(c.isupper() for c in letters)


_WORD_AFTER = re.compile(r"[\s\"“„«‹‚¿¡(\[（「『'‘—–-]*([^\W\d_][^\s.,;:!?)\]»”“\"]*|\d\S*)?")
_WORD_BEFORE = re.compile(r"[^\s(\[«„“\"]+$")


def _shouted(text: str, begin: int, dot: int, after: int) -> bool:
    """Whether a sentence in capitals goes on over the full stop: only capitals on both sides."""
    words = re.findall(r"[^\W\d_]+", text[after : after + 40])[:2]
    last = re.match(r"\W*[^\W\d_]{3,}[.!?]", text[after : after + 40])  # one more word, and the sentence ends
    if last:
        words = words[:1]
    if not words or not all(w.isupper() for w in words) or max(map(len, words)) < 2:
        return False
    before = re.findall(r"[^\W\d_]{2,}", text[max(begin, dot - 60) : dot])[-3:]
    return bool(before) and all(_caps(w) for w in before) and (len(before) > 1 or len(words) > 1)


def _first_part(text: str, start: int, dot: int, end: int) -> bool:
    """Whether the full stop is an inner one of an abbreviation of several parts, as in "d. h."."""
    part = text[start:dot].lower()
    if part not in _first_parts():
        return False
    m = _NEXT_PART.match(text, dot + 1, end)
    return m is not None and f"{part}.{m.group(1).lower()}" in _several()


class _Later:
    """Where signs come next in a block that is read forwards; each sign's places are passed over once."""

    def __init__(self, text: str, end: int):
        self.text, self.end = text, end
        self.next: dict[str, int] = {}

    def find(self, sign: str, at: int) -> int:
        """The first place of ``sign`` from ``at`` on in the block, -1 if there is none; ``at`` never goes down from call to call."""
        known = self.next.get(sign, 0)
        if known >= 0 and known < at or sign not in self.next:
            known = self.next[sign] = self.text.find(sign, at, self.end)
        return known

    def closes(self, at: int, closer: str) -> bool:
        """Whether a pair opened at ``at`` is closed before the block ends; else its opener is an ordinary sign."""
        return self.find(closer, at + 1) >= 0


def _prose(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """The units of ``text[begin:end]``, one block without blank lines, as half-open ranges with outer blanks."""
    later = _Later(text, end)
    stack: list[tuple[str, int, bool]] = []  # (closer, where it was opened, whether it began the unit)
    unit = begin
    i = begin
    while True:
        m = _EVENT.search(text, i, end)
        if m is None:
            break
        at = m.start()
        c = text[at]
        i = at + 1
        if stack and c == stack[-1][0]:
            stack.pop()
            continue
        if c == '"':
            opens = (at == begin or text[at - 1].isspace() or text[at - 1] in "([—–-/:：") or at == unit
            inch = at > begin and text[at - 1].isdigit()
            if opens and not inch and i < end and not text[i].isspace() and later.closes(at, '"'):
                stack.append(('"', at, not text[unit:at].strip()))
            continue
        if c in PAIRS:
            closer = PAIRS[c]
            if c == "“" and later.find("”", i) < 0:
                closer = "“" if later.find("“", i) >= 0 else ""
            if c == "„" and later.find("“", i) < 0 <= later.find("”", i):
                closer = "”"
            if closer and later.closes(at, closer):
                stack.append((closer, at, not text[unit:at].strip()))
            continue
        if c not in TERMINATORS:
            # a closer of an outer pair closes what is open inside it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == c:
                    del stack[k:]
                    break
            continue

        # the run of terminators
        j = at
        while j + 1 < end and text[j + 1] in TERMINATORS:
            j += 1
        run = text[at : j + 1]
        i = j + 1
        dots = run.strip(".") == ""
        ellipsis = (dots and len(run) >= 3) or "…" in run and run.strip("….") == ""
        if dots and len(run) == 1:
            prev = text[at - 1] if at > begin else " "
            nxt = text[i] if i < end else " "
            if prev.isspace() and nxt.isalnum():
                continue  # ".5"
            if nxt.isdigit() or nxt.islower() or nxt in "_/\\@-":
                continue  # a decimal, a file name, an address
            if nxt in ",;:":
                continue
            if nxt.isalpha() and nxt.isupper():
                follow = text[i + 1] if i + 1 < end else " "
                if not (follow.islower() or follow in " \n\"'" and nxt == "A"):
                    continue  # "U.S", "v2.A"
                if not (prev.isalnum() or prev in ")]»”\"%"):
                    continue
                w = _WORD_BEFORE.search(text, max(unit, at - 30), at)
                if w and len(re.sub(r"\W", "", w.group().rpartition(".")[2])) < 2 and not prev.isdigit() and prev not in ")]»”\"%" and not re.search(r"\d\s[a-z]$", text[max(unit, at - 3) : at]):
                    continue  # initials without blanks

        # closing quotes and brackets belong to the sentence; some languages put a blank before them
        k = i
        closed_quote = closed_own = closed_bracket = colon = False
        while stack and k < end:
            p = k
            while p < end and text[p] in "   " and not closed_quote and p - k < 2:
                p += 1
            if p < end and text[p] == stack[-1][0] and (p == k or text[p] in "»”"):
                opened = stack.pop()
                if text[opened[1]] in BRACKET_OPENERS:
                    closed_bracket = True
                else:
                    closed_quote = True
                closed_own = opened[2]
                before = text[unit : opened[1]].rstrip()
                colon = before[-1:] in (":", "：")
                k = p + 1
            else:
                break
        while k < end and text[k] in TERMINATORS and (closed_quote or closed_bracket):
            k += 1
            closed_quote = closed_bracket = False  # "...end).": the last one decides
            dots = text[k - 1] == "."
        if not (closed_quote or closed_bracket) and k < end and text[k] in "”’'" and text[k] not in PAIRS:
            k += 1
        i = max(i, k)
        if stack:
            continue  # inside a quotation or bracket
        if k >= end:
            break

        rest = _WORD_AFTER.match(text, k, end)
        word = (rest.group(1) or "") if rest else ""
        lead = text[k : rest.start(1)] if rest and rest.group(1) else text[k : k + 1]
        first = word[:1]
        spaced = text[k].isspace()
        mark = lead.strip()[:1]
        wide = run[-1] in _WIDE
        lower = first.islower()

        if text[k] in ",;:，；：、" or (mark in ("—", "–", "-") and spaced and (closed_quote or lower)):
            continue
        if closed_bracket and not closed_own:
            continue  # a full stop within brackets inside a sentence
        if closed_quote:
            if wide or not first or "぀" <= first <= "鿿":
                if colon and not text.startswith(("と", "って", "（", "("), k) or spaced and first:
                    yield unit, k
                    unit = k
                continue
            if lower or _shouted(text, unit, at, k) or text[k] in "(（" or not spaced and not first.isupper():
                continue
            if first and not first.isupper() and not first.isdigit() and not colon and not closed_own:
                continue  # scripts without case: the quotation is part of the sentence
            yield unit, k
            unit = k
            continue
        if ellipsis:
            if wide or "぀" <= text[k] <= "鿿":
                tail = re.compile(r"[^，。！？（；…、\n]*").match(text, k, end).group()
                if len(tail) <= 4:
                    continue
            elif lower or _shouted(text, unit, at, k):
                continue
            yield unit, k
            unit = k
            continue
        if wide or run[-1] in "।॥؟۔":
            yield unit, k
            unit = k
            continue
        if run[-1] in "!?" or len(run) > 1:
            if not spaced and not (first.isalpha() or lead.strip()):
                continue
            yield unit, k
            unit = k
            continue

        # one full stop
        kind, start = _abbreviation(text, at, unit)
        prev = text[at - 1] if at > unit else " "
        if kind and start > unit and text[start - 1] == "/":
            kind = None
        before_num = re.search(r"[\d½¼¾]\s*$", text[max(unit, start - 6) : start]) is not None if kind else False
        if kind == "unit-or-number":
            kind = "unit" if before_num else "number"
        if kind == "open":
            if not (before_num and text[start:at].lower() in ("m", "mm", "h", "t", "s")):
                continue
        if kind == "number" and (first.isdigit() or first in "№" or text[start:at].lower() in ("s", "p", "т", "п", "n") and not before_num):
            continue
        if kind == "unit":
            if not before_num:
                continue
            if lower or _shouted(text, unit, at, k):
                continue
        if kind == "close" and (lower or first.isdigit() and text[start:at].lower() in ("fm", "co") or _shouted(text, unit, at, k)):
            continue
        token = _WORD_BEFORE.search(text, max(unit, at - 12), at)
        if token and len(token.group()) <= 4 and not before_num and _first_part(text, token.start(), at, end):
            continue
        if kind is None:
            # an initial before a name
            if prev.isalpha() and prev.isupper() and (at - 1 == unit or not text[at - 2].isalnum()) and (first.isupper() or not first or not first.isascii()):
                b = text[max(unit, at - 24) : at - 1].rstrip()
                unit_letter = bool(re.search(r"\d$", b)) and prev in "MHTGA"
                if not unit_letter and not (at >= 2 and text[at - 2] in "-/."):
                    continue
            # an ordinal before a month
            if prev.isdigit() and re.search(r"(?:^|[\s(])\d{1,2}$", text[max(unit, at - 4) : at]) and word.lower().rstrip("aes'") in _MONTH_STEMS:
                continue
        yield unit, k
        unit = k
    if unit < end:
        yield unit, end


_MONTH_STEMS = frozenset(m.rstrip("aes'") for m in MONTHS)


def _thai(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Splits a unit of Thai at blanks where a new clause begins; other text stays whole."""
    span = text[begin:end]
    if len(_THAI.findall(span)) * 3 < len(span.strip()):
        yield begin, end
        return
    unit, depth, i = begin, 0, begin
    while i < end:
        c = text[i]
        if c in "([（":
            depth += 1
        elif c in ")]）":
            depth = max(0, depth - 1)
        elif c.isspace() and not depth:
            j = i
            while j < end and text[j].isspace():
                j += 1
            if j < end and i > unit:
                left, right = text[i - 1], text[j]
                if _THAI.match(right):
                    goes_on = text.startswith(THAI_GOES_ON, j) or left in ",;:("
                    # a word that only links to a number or a tag is no clause
                    if not goes_on:
                        yield unit, i
                        unit = i
                elif right.isascii() and right.isupper() and re.match(r"[A-Z][a-z]+ [a-z]", text[j : j + 30]) and _THAI.match(left):
                    yield unit, i
                    unit = i
            i = j
            continue
        i += 1
    if unit < end:
        yield unit, end


def _blocks(text: str) -> Iterator[list[tuple[int, int]]]:
    """Lines (half-open, without their ends) grouped by blank lines."""
    block: list[tuple[int, int]] = []
    at, n = 0, len(text)
    while at < n:
        m = _LINE.match(text, at)
        line = m.group()
        body = line.rstrip("\r\n")
        if body.strip():
            block.append((at, at + len(body)))
        elif block:
            yield block
            block = []
        at = m.end()
        if m.end() == m.start():
            break
    if block:
        yield block


def _kind(text: str, a: int, b: int) -> str:
    """What a line is by itself: list, log, table or prose."""
    line = text[a:b]
    if line.count("|") >= 2 or line.count("\t") >= 2 and line.strip().count("\t") >= 2:
        return "table"
    m = _LOG_WORD.match(line)
    if m:
        w = m.group(1)
        if (w[0].isupper() or w[0].isdigit()) and not re.match(r"(?i)(hrs?|h|uhr|kl)\b", w):
            return "log"
    if _MARKER.match(line):
        return "list"
    return "prose"


def _heading(text: str, a: int, b: int) -> bool:
    return re.match(r"#{1,6}\s", text[a:b].lstrip()) is not None


def _rules_begin(text: str, block: list[tuple[int, int]], kinds: list[str]) -> int:
    """The first line after the first one from which on lines stand for themselves, or how many lines there are.

    Wrapped prose may break before a number or a dash. So a line that looks like an item, entry or row is one only after a heading or a colon, as the first of
    two of its kind, as a bullet that comes again or a 1 that a 2 follows, or as a bullet after the end of a sentence.
    """
    marks = [_MARKER.match(text, a, b).group().strip(" \t().") if kind == "list" else "" for (a, b), kind in zip(block, kinds)]
    last = {m: i for i, m in enumerate(marks)}
    for i in range(1, len(block)):
        if kinds[i] == "prose":
            continue
        before = text[slice(*block[i - 1])].rstrip()
        bullet = kinds[i] == "list" and not marks[i].isdigit()
        again = kinds[i + 1 : i + 2] == [kinds[i]] or bullet and last[marks[i]] > i or marks[i] == "1" and last.get("2", 0) > i
        if again or _heading(text, *block[i - 1]) or before[-1:] in (":", "：") or bullet and before[-1:] in TERMINATORS:
            return i
    return len(block)


def spans(text: str | None) -> list[tuple[int, int]]:
    """Half-open code point ranges of the sentence units of ``text``, without outer white space, in order."""
    if text is None:
        return []
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    def prose(a: int, b: int) -> None:
        for x, y in _prose(text, a, b):
            for u, v in _thai(text, x, y):
                add(u, v)

    for block in _blocks(text):
        kinds = [_kind(text, a, b) for a, b in block]
        ruled = kinds[0] != "prose" and (len(kinds) == 1 or kinds[1] != "prose" or kinds[0] == "list")
        if not ruled:
            n = _rules_begin(text, block, kinds)
            heading, flow = block[0], block[:n]
            if _heading(text, *heading):
                add(*heading)
                flow = flow[1:]
            if flow:
                prose(flow[0][0], flow[-1][1])
            block, kinds = block[n:], kinds[n:]
        # lines of their own; a line without a mark of its own continues the list item before it
        items: list[list] = []
        for (a, b), kind in zip(block, kinds):
            if kind == "prose" and items and items[-1][2] == "list":
                items[-1][1] = b
            else:
                items.append([a, b, kind])
        for a, b, kind in items:
            if kind == "list":
                m = _MARKER.match(text, a, b)
                body = m.end()
                first = True
                for x, y in _prose(text, body, b):
                    for u, v in _thai(text, x, y):
                        add(a if first else u, v)
                        first = False
                if first:
                    add(a, b)
            elif kind == "prose":
                prose(a, b)
            else:
                add(a, b)
    return out


def split_sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, sent_start, sent_end``: code point positions (from 1) of the first and last character of each unit of ``text``.

    Units do not overlap and cover all but white space. Null, empty and blank texts give no row; rows with the same key give their units
    each (make them distinct first if they are copies). A narrow operation: texts are read whole, one at a time.
    """
    source = df.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("__text"))
    schema = T.StructType([df.schema[key], T.StructField("sent_start", T.LongType()), T.StructField("sent_end", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for r, t in enumerate(batch.column(1).to_pylist()):
                for a, b in spans(t):
                    rows.append(r)
                    starts.append(a + 1)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[key, "sent_start", "sent_end"])

    return source.mapInArrow(run, schema)
