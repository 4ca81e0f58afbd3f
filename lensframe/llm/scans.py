"""Noise in text from scanned pages: furniture, broken words, misread characters, and reflow into paragraphs.

Skip-gram vectors and a lexicon are learned from all pages. Every word, a rare one too, has the vector of the company it keeps: the mean of the
skip-gram vectors around its occurrences. A rare word is linked to the frequent neighbours of its vector of which plausible glyph edits make it, and
each occurrence is corrected to the linked word that suits its own context best.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensframe.session import cut, written

#: The strokes that glyphs are made of; what a scan takes for one another has the same strokes.
STROKES = str.maketrans(
    {"@": "a", "!": "i", "1": "i", "l": "i", "|": "i", "0": "o", "5": "s", "$": "s", "c": "e", "€": "e", "t": "f", "q": "g", "9": "g", "2": "z"}
    | {"d": "ei", "n": "ri", "m": "rri", "u": "ii", "w": "vv", "h": "ii", "b": "ii", "8": "ii", "6": "ii"}
)
#: What a scan puts for what is printed.
GLYPH_EDITS = (
    ("e", "c"), ("c", "e"), ("n", "ri"), ("u", "ii"), ("m", "rn"), ("rn", "m"), ("a", "@"), ("i", "!"), ("i", "1"), ("i", "l"), ("l", "1"), ("l", "i"), ("l", "!"), ("l", "|"), ("i", "|"),
    ("o", "0"), ("s", "5"), ("s", "$"), ("b", "8"), ("b", "6"), ("g", "9"), ("t", "f"), ("f", "t"), ("g", "q"), ("q", "g"), ("d", "cl"), ("cl", "d"), ("h", "b"), ("b", "h"), ("h", "li"), ("li", "h"),
    ("w", "vv"), ("vv", "w"), ("ri", "n"), ("ii", "u"), ("z", "2"), ("e", "€"), ("nn", "rm"), ("rm", "nn"),
)
#: Letters that a scan puts for digits.
DIGITS = str.maketrans({"O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "b": "6", "G": "6", "B": "8", "g": "9", "q": "9", "A": "4", "T": "7"})
#: Signs that break a word at the end of a line; the first two may also be part of a word.
HYPHENS = "-‐‑¬­"
PLAIN_HYPHENS = "-‐‑"
OUTER = ".,;:?()[]{}«»\"“”„‘’'…"

#: How many lines from a page's edge count as its edge, how much of a furniture pattern may be elsewhere, and the chance at which any pattern of
#: the corpus may be at edges by accident as often as it is.
EDGE_LINES, FURNITURE_INNER, FURNITURE_CHANCE = 3, 0.03, 0.01
#: Patterns of furniture that are handed to all tasks as a set; more of them are joined with the documents.
FURNITURE_SHARED = 200_000
#: A frequent word is so many times as frequent as its misreadings: without vectors, and at least.
RATIO, RATIO_BACKED = 18.0, 4.0
#: A neighbour is this much less like a word than the word's nearest at most. Evidence is the logarithm of the ratio, the likeness with a weight, and
#: a share where a text layer has the frequent word only; as much as the ratio alone needs without vectors, and so much more where contexts tell, makes a link.
NEAR_GAP, LIKENESS_WEIGHT, BACKED_WEIGHT, EVIDENCE_MORE = 0.7, 4.0, math.log(RATIO / RATIO_BACKED), 1.6
#: Skip-gram vectors are trained for the most frequent words, so many at most; every other word has its vector by its contexts, as all have.
VOCABULARY_MOST, VOCABULARY_LEAST, VECTOR_SIZE, CONTEXT_WINDOW = 100_000, 5, 24, 4
#: The threshold of skip-gram training above which frequent words are thinned out, as published for it.
THINNING = 1e-4

_LINE_END = re.compile(r"\r\n|\n|\r")
_GAP = re.compile(r"\s{2,}|\t+")
_LETTERS = re.compile(r"[^\W\d_]{2}")
#: A number or tag, alone and with the word before it that says what it is.
_TAG = r"(?:\S*\d+[/-]\S*|\b\d+(?:\.\d+)*\b)"
_TAGS, _LABEL = re.compile(_TAG), re.compile(rf"([^\W\d_]{{2,}})[.:]?\s*(?={_TAG})")
_LETTERS_ALL, _WITH_DIGIT = re.compile(r"[^\W\d_]{2,}"), re.compile(r"\S*\d\S*")
_WORD = re.compile(r"[\w@!|$€]*[^\W\d_][\w@!|$€]*")
_ROMAN = re.compile(r"(?=[ivxlc])(?:c{0,3})(?:x?l{1,2}x{0,3}|l?x{0,4}|xc|xl)?(?:l?)(?:ix|iv|v?i{0,4})$", re.I)
_PAGE = re.compile(
    r"""^(?:(?P<word>page|pag\.?|side|seite|sida|p\.|s\.|pp\.)\s*(?P<a>[\dOoIlSB|]{1,5})(?:\s*(?:of|av|von|/)\s*[\dOoIlSB|]{1,5})?
        |[-–—]\s*(?P<b>[\dOoIlSB|]{1,5})\s*[-–—]|\[\s*(?P<c>[\dOoIlSB|]{1,5})\s*\]|\(\s*(?P<d>[\dOoIlSB|]{1,5})\s*\)
        |(?P<e>[\dOoIlSB|]{1,4})\s*/\s*[\dOoIlSB|]{1,4})$""",
    re.I | re.X,
)


def split_lines(page: str) -> list[str]:
    return _LINE_END.split(page)


@lru_cache(200_000)
def fold(word: str) -> str:
    """One spelling for all words that a scan may take for one another."""
    return word.lower().translate(STROKES).replace("rrri", "riri")


@lru_cache(200_000)
def edits(printed: str, read: str) -> int | None:
    """The least number of glyph edits that make ``read`` of ``printed``; None if no plausible ones do."""
    n, m = len(printed), len(read)
    best: list[list[int | None]] = [[None] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            here = best[i][j]
            if here is None:
                continue
            if i < n and j < m and printed[i] == read[j] and (best[i + 1][j + 1] is None or best[i + 1][j + 1] > here):
                best[i + 1][j + 1] = here
            for x, y in GLYPH_EDITS:
                if printed.startswith(x, i) and read.startswith(y, j):
                    at = best[i + len(x)][j + len(y)]
                    if at is None or at > here + 1:
                        best[i + len(x)][j + len(y)] = here + 1
    return best[n][m]


@lru_cache(200_000)
def mask(word: str) -> str:
    """The word with its digits masked: numbers and tags of one form are one entry of the lexicon."""
    return re.sub(r"\d+", "#", word)


def bare(token: str) -> str:
    """The token without outer punctuation."""
    t = token.strip(OUTER)
    return t.rstrip("!") if len(t) > 1 else t


@lru_cache(200_000)
def key_of(token: str) -> str:
    """The lexicon's entry of a token: masked if it has digits and is no word with one digit for a letter."""
    t = bare(token)
    digits = sum(c.isdigit() for c in t)
    if digits and (digits > 1 and digits * 2 >= sum(c.isalpha() for c in t) or digits == len(re.sub(r"\W", "", t)) or "-" in t or "/" in t):
        return "#" + mask(t)
    return t.lower()


def numeric_fix(token: str) -> str | None:
    """The masked form of a number or tag whose letters beside digits are read as digits; None if nothing changes."""
    t = bare(token)
    if not any(c.isdigit() for c in t):
        return None
    fixed = list(t)
    for i, c in enumerate(t):
        if c.isalpha() or c in "|!":
            beside = (i > 0 and (t[i - 1].isdigit() or fixed[i - 1].isdigit())) or (i + 1 < len(t) and t[i + 1].isdigit())
            d = c.translate(DIGITS)
            if beside and d.isdigit():
                fixed[i] = d
    new = "".join(fixed)
    return "#" + mask(new) if new != t else None


def page_number(segment: str) -> tuple[str, int | None] | None:
    """The form and number of a text that may be a page number, else None."""
    s = segment.strip()
    m = _PAGE.match(s)
    if m:
        form = (m.group("word") or "").lower().rstrip(".") or next(k for k in "bcde" if m.group(k))
        text = next(m.group(k) for k in "abcde" if m.group(k))
        digits = text.translate(DIGITS)
        return form, int(digits) if digits.isdigit() else None
    if re.fullmatch(r"\d{1,4}", s):
        return "bare", int(s)
    if re.fullmatch(r"[\dOoIl]{1,4}", s) and any(c.isdigit() for c in s):
        return "bare", int(s.translate(DIGITS))
    if 0 < len(s) <= 9 and re.fullmatch(r"[ivxlcIVXLC]+", s) and (s.islower() or s.isupper()) and _ROMAN.match(s):
        return "roman", _roman(s.lower())
    return None


def _roman(s: str) -> int:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    n = [values[c] for c in s]
    return sum(-v if any(w > v for w in n[i + 1 : i + 2]) else v for i, v in enumerate(n))


def pattern(line: str) -> str:
    """The form of a furniture line: folded, with numbers masked and blanks single."""
    return " ".join(map(_form, line.split()))


@lru_cache(200_000)
def _form(token: str) -> str:
    return "#" if _numeric(token) else fold(token)


@lru_cache(200_000)
def _numeric(token: str) -> bool:
    """Whether a token is a number or a tag, not a word with a digit for a letter."""
    digits = sum(c.isdigit() for c in token)
    return digits > 0 and (digits > 1 or digits * 2 >= sum(c.isalnum() for c in token))


def pattern_key(line: str) -> int:
    """A number for the form of a line."""
    return xxhash.xxh64_intdigest(pattern(line)) - 2**63


def edge_patterns(pages: list[str | None]) -> tuple[set[int], set[int]]:
    """The forms of a document's lines at the edges of its pages and of those within; segments of edge lines beside a page number too."""
    edge: set[int] = set()
    inner: set[int] = set()
    for page in pages:
        if not page:
            continue
        lines = [x for x in split_lines(page) if x.strip()]
        for i, line in enumerate(lines):
            if not _LETTERS.search(line):
                continue
            d = min(i, len(lines) - 1 - i)
            (edge if d < EDGE_LINES else inner).add(pattern_key(line))
            if d < EDGE_LINES:
                edge.update(pattern_key(s) for s in _without_number(line)[1:])
    return edge, inner


def layout(pages: list[str | None], name: str | None, common: frozenset[int] | set[int]) -> list[tuple[int, int, str, bool, bool]]:
    """``(page_no, line_no, line, header, pageno)`` of the lines of a document that are not blank.

    Furniture is looked for from both edges of a page inwards, as long as lines are furniture: a line that repeats at the edge of another page,
    that is furniture all over the corpus (``common``: keys of patterns), or whose words, but for those that name a number, are those of the document's name.
    """
    named = [fold(w) for w in re.findall(r"[^\W\d_]{2,}", re.sub(r"[-_]\d.*", "", (name or "").rpartition(".")[0]) or "")]
    title, most_missing = set(named), len(named) // 4
    whole_name = fold(re.sub(r"[\W_]", "", name or ""))
    docs: list[tuple[int, list[tuple[int, str]]]] = []
    repeats: Counter = Counter()
    for p, page in enumerate(pages, 1):
        lines = [(k, x) for k, x in enumerate(split_lines(page), 1) if x.strip()] if page else []
        docs.append((p, lines))
        seen = set()
        for i, (_, x) in enumerate(lines):
            for where, d in (("top", i), ("end", len(lines) - 1 - i)):
                if d < EDGE_LINES:
                    for s in _without_number(x):
                        if _LETTERS.search(s):
                            seen.add((where, _exact(s)))
        repeats.update(seen)

    def header(text: str, where: str) -> bool:
        t = text.strip()
        if not t:
            return False
        if pattern_key(t) in common:
            return True
        words = _LETTERS_ALL.findall(_WITH_DIGIT.sub(" ", t))
        if not words:
            # a tag alone: that of the document
            tag = fold(re.sub(r"[\W_]", "", t))
            return where == "top" and len(tag) > 4 and any(c.isdigit() for c in t) and tag in whole_name
        if t[-1] in ".,;":
            return False
        if repeats[where, _exact(t)] >= max(3 if _prose(words) else 2, 0.4 * len(docs)) and len(docs) > 1 and not _goes_on(t):
            return True
        if not title or t[-1] == ")":
            return False
        own = {fold(w) for w in _WORD.findall(_TAGS.sub(" ", t)) if len(w) > 1}
        if len(title - own) > most_missing:
            return False
        free = {fold(w) for w in _LABEL.findall(t)}
        return all(w in title or w in free for w in own)

    # page numbers that go up with the pages
    candidates: list[tuple[int, int, str, int | None, str]] = []  # page, line, form, number, where
    for p, lines in docs:
        for i, (k, x) in enumerate(lines):
            for where, d in (("top", i), ("end", len(lines) - 1 - i)):
                if d < EDGE_LINES:
                    for form, number in _numbers(x):
                        candidates.append((p, k, form, number, where))
    offsets = Counter()
    for p, _, form, number, where in {(p, 0, f, n, w) for p, _, f, n, w in candidates}:
        if number is not None:
            offsets[form, where, number - p] += 1
    out: list[tuple[int, int, str, bool, bool]] = []
    for p, lines in docs:
        marks: dict[int, tuple[bool, bool]] = {}
        for where in ("top", "end"):
            order = lines if where == "top" else lines[::-1]
            numbered = False
            for i, (k, x) in enumerate(order[:EDGE_LINES]):
                is_header, is_number = False, False
                if header(x, where) and not _numbers_whole(x):
                    is_header = True
                    # a header with the number on its line
                    segments = _GAP.split(x.strip())
                    if len(segments) > 1:
                        for seg in (segments[0], segments[-1]):
                            n = page_number(seg)
                            if n and _counts(n, p, where, offsets, True, order, i):
                                is_number = True
                else:
                    whole = page_number(x)
                    if whole and not numbered and _counts(whole, p, where, offsets, False, order, i):
                        is_number = True
                    elif not whole:
                        segments = _GAP.split(x.strip())
                        if len(segments) > 1:
                            for seg, rest in ((segments[0], segments[1:]), (segments[-1], segments[:-1])):
                                n = page_number(seg)
                                if n and header("   ".join(rest), where):
                                    is_header = True
                                    is_number = _counts(n, p, where, offsets, True, order, i)
                                    break
                if not (is_header or is_number):
                    break
                numbered |= is_number
                marks[k] = (is_header, is_number)
        for k, x in lines:
            h, n = marks.get(k, (False, False))
            out.append((p, k, x, h, n))
    return out


def _goes_on(text: str) -> bool:
    """Whether a line looks like prose that goes on: it has a sentence's end inside, or begins in lower case."""
    return bool(re.search(r"[a-zæøåäöüß]{2}[.!?]\s+[A-ZÆØÅÄÖÜ«„\"]", text)) or text[:1].islower()


def _prose(words: list[str]) -> bool:
    """Whether words read as a piece of a sentence: several, and more than half in lower case."""
    return len(words) > 4 and 2 * sum(w.islower() for w in words) > len(words)


def _exact(text: str) -> str:
    """A line with its numbers but folded: the same line on another page, read otherwise."""
    return " ".join(map(fold, text.split()))


def _without_number(line: str) -> list[str]:
    segments = _GAP.split(line.strip())
    out = [line.strip()]
    if len(segments) > 1:
        if page_number(segments[0]):
            out.append("  ".join(segments[1:]))
        if page_number(segments[-1]):
            out.append("  ".join(segments[:-1]))
    return out


def _numbers_whole(line: str) -> bool:
    return page_number(line) is not None


def _numbers(line: str) -> list[tuple[str, int | None]]:
    whole = page_number(line)
    if whole:
        return [whole]
    segments = _GAP.split(line.strip())
    return [n for n in (page_number(s) for s in (segments[0], segments[-1])) if n] if len(segments) > 1 else []


def _counts(found: tuple[str, int | None], page: int, where: str, offsets: Counter, beside: bool, order: list, i: int) -> bool:
    """Whether a candidate is the page's number: its form tells, or it goes up with the pages, or nothing speaks against it."""
    form, number = found
    same = max((n for (f, w, d), n in offsets.items() if f == form and w == where), default=0)
    steady = number is not None and offsets[form, where, number - page] > 1
    if steady or beside:
        return True
    if form in ("bare", "roman"):
        if same > 1:
            return False  # others go up, this one does not
        near = [order[j][1].strip() for j in (i - 1, i + 1) if 0 <= j < len(order)]
        if any(re.fullmatch(r"[\d.,]+", x) for x in near):
            return False
        if form == "bare" and number == 0:
            return False
        return i == 0 or form == "roman" or not re.match(r"\s", order[i][1]) is None or i < 2
    return True




def _ends_broken(line: str) -> tuple[str, str] | None:
    """The last token without its hyphen and the hyphen, if the line ends in one that touches a word."""
    s = line.rstrip()
    if len(s) > 1 and s[-1] in HYPHENS and (s[-2].isalnum() or s[-2] in "@!"):
        return s.split()[-1][:-1], s[-1]
    return None


def text_lines(rows: list[tuple[int, int, str, bool, bool]]) -> list[tuple[int, int, str]]:
    """The lines that are text, in order over all pages."""
    return [(p, k, x) for p, k, x, h, n in rows if not h and not n]


def lexicon_counts(lines: list[tuple[int, int, str]], layer: set[int]) -> tuple[Counter, Counter, list[str]]:
    """Counts of lexicon entries over whole tokens, on pages with a text layer and on all, and the entries of all tokens in order. Parts of broken words do not count."""
    sure: list[str] = []
    every: list[str] = []
    whole: list[str] = []
    broken = False
    for p, _, line in lines:
        keys = list(map(key_of, line.split()))
        whole += keys
        ends = _ends_broken(line) is not None
        use = keys[1 if broken else 0 : len(keys) - 1 if ends else len(keys)]
        every += use
        if p in layer:
            sure += use
        broken = ends
    return _with_parts(Counter(sure)), _with_parts(Counter(every)), [k for k in whole if k]


def _with_parts(counts: Counter) -> Counter:
    """Counts without what is no entry; the parts of compounds count as words as well."""
    for k in ("", "#"):
        counts.pop(k, None)
    for k, n in [(k, n) for k, n in counts.items() if "-" in k and not k.startswith("#")]:
        for part in k.split("-"):
            if len(part) > 1:
                counts[part] += n
    return counts


def layer_pages(pages: list[str | None], ocr_pages: int | None) -> set[int]:
    """Numbers of the pages that are known to have a text layer: those before the last ``ocr_pages`` pages with text."""
    filled = [i for i, p in enumerate(pages, 1) if p and p.strip()]
    if ocr_pages is None or ocr_pages < 0:
        return set()
    return set(filled[: max(0, len(filled) - ocr_pages)])


# ---------------------------------------------------------------------------------------------------------------- Spark


def _documents(df: DataFrame) -> DataFrame:
    docs = df.where(F.col("pages").isNotNull() & (F.size("pages") > 0)).select("scan_id", "name", "pages", "ocr_pages").dropDuplicates()
    return docs.withColumn("doc_no", F.xxhash64("name", "pages", "ocr_pages"))


def _batches(rows: Iterator[tuple], schema: T.StructType, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches that go out as they fill."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], names=schema.names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], names=schema.names)


def _map(df: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """``fn`` gives the rows of each document."""
    return _stream(df, lambda docs: (row for r in docs for row in fn(r)), schema)


def _stream(df: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """``fn`` gives the rows of a task's documents, which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = (r for b in batches for a in range(0, b.num_rows, 256) for r in b.slice(a, 256).to_pylist())
        yield from _batches(fn(documents), schema)

    return df.mapInArrow(run, schema)


_PATTERNS = T.StructType([T.StructField("pattern", T.LongType()), T.StructField("edge", T.LongType()), T.StructField("inner", T.LongType())])
_LINE = T.StructType([T.StructField("page_no", T.IntegerType()), T.StructField("line_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("header", T.BooleanType()), T.StructField("pageno", T.BooleanType())])
_COUNT = T.StructType([T.StructField("entry", T.StringType()), T.StructField("sure", T.LongType()), T.StructField("every", T.LongType())])
_LINES = T.StructType(
    [
        T.StructField("scan_id", T.LongType()),
        T.StructField("doc_no", T.LongType()),
        T.StructField("lines", T.ArrayType(_LINE)),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("counts", T.ArrayType(_COUNT)),
    ]
)
_READ = T.StructType(
    [
        T.StructField("scan_id", T.LongType()), T.StructField("doc_no", T.LongType()), T.StructField("page_no", T.IntegerType()), T.StructField("line_no", T.IntegerType()), T.StructField("token_no", T.IntegerType()),
        T.StructField("token", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("entry", T.StringType()), T.StructField("other", T.StringType()), T.StructField("cut_at", T.IntegerType()),
        T.StructField("next_page", T.IntegerType()), T.StructField("next_line", T.IntegerType()), T.StructField("sign", T.StringType()), T.StructField("parts_known", T.BooleanType()), T.StructField("n", T.LongType()),
        T.StructField("around", T.ArrayType(T.FloatType())),
    ]
)


class ScanModel:
    """What is learned from all pages: the pages laid out (``lines``), a lexicon, the words that rare ones stand for (``corrections``), skip-gram vectors
    (words and a matrix), the vectors of the surroundings of frequent words (``frequent``), and what is to decide (``suspects``)."""

    def __init__(self, lines: DataFrame, lexicon: DataFrame, corrections: DataFrame, vectors: tuple[list[str], np.ndarray], frequent: np.ndarray, suspects: DataFrame):
        self.lines, self.lexicon, self.corrections, self.vectors, self.frequent, self.suspects = lines, lexicon, corrections, vectors, frequent, suspects


def furniture_patterns(docs: DataFrame) -> DataFrame:
    """``pattern``: keys of the forms of lines that are at page edges in more documents than chance explains, and hardly anywhere else.

    A form that documents place anywhere is at an edge with the share that edges have of all forms. Furniture is what would be there so often with
    less than ``FURNITURE_CHANCE`` for all forms of the corpus together: the number of documents it takes grows with the logarithm of the corpus only.
    """

    def rows(documents: Iterator[dict]) -> Iterator[tuple]:
        counts: dict[int, list[int]] = {}
        for r in documents:
            for side, keys in enumerate(edge_patterns(r["pages"])):
                for p in keys:
                    counts.setdefault(p, [0, 0])[side] += 1
            if len(counts) > 500_000:
                yield from ((p, e, i) for p, (e, i) in counts.items())
                counts = {}
        yield from ((p, e, i) for p, (e, i) in counts.items())

    counted = cut(_stream(docs.select("pages"), rows, _PATTERNS).groupBy("pattern").agg(F.sum("edge").alias("edge"), F.sum("inner").alias("inner")))
    all_ = counted.agg(F.sum("edge").alias("edge"), F.sum("inner").alias("inner"), F.count("*").alias("n")).first()
    if not all_["n"] or not all_["edge"]:
        return counted.select("pattern").limit(0)
    share = min(0.9, all_["edge"] / (all_["edge"] + all_["inner"]))
    # the chance of e or more edges among e + i places is at most that of e edges times a constant near 1, as i is a small part of e
    e, i = F.col("edge").cast("double"), F.col("inner").cast("double")
    choose_ = _log_factorial(e + i) - _log_factorial(e) - _log_factorial(i)
    chance = choose_ + e * math.log(share) + i * math.log(1 - share)
    return counted.where((F.col("inner") <= FURNITURE_INNER * F.col("edge")) & (F.col("edge") > 1) & (chance < math.log(FURNITURE_CHANCE / all_["n"]))).select("pattern")


def _log_factorial(n: Column) -> Column:
    """The logarithm of n!, by Stirling's series."""
    m = n + 1
    return (m - 0.5) * F.log(m) - m + 0.5 * math.log(2 * math.pi) + 1 / (12 * m)


def learn(df: DataFrame) -> ScanModel:
    """Learns from all documents of ``df`` (scan_id, name, pages, ocr_pages); exact duplicate rows count once."""
    docs = written(_documents(df))
    lines_and_counts = _laid_out(docs, furniture_patterns(docs))
    lines = lines_and_counts.where("lines is not null").select("scan_id", "doc_no", "lines", "words")
    counted = lines_and_counts.where("counts is not null").select(F.explode("counts").alias("c")).groupBy("c.entry").agg(F.sum("c.sure").alias("sure"), F.sum("c.every").alias("every"))
    lexicon = cut(_with_fold(counted))
    vectors = _vectors(lines, lexicon)
    links = cut(_links(lexicon))
    read = written(_read(lines, links, vectors))
    likeness, frequent = _likeness(links, read, vectors)
    return ScanModel(lines.drop("words"), lexicon, _corrections(lexicon, likeness), vectors, frequent, read.where("kind <> 'context'"))


def _laid_out(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows of the documents with their lines and the lexicon's entries of their text, in order; and rows with counts of entries over many documents."""
    spark = docs.sparkSession
    patterns = cut(patterns)
    if patterns.count() <= FURNITURE_SHARED:
        shared = spark.sparkContext.broadcast(frozenset(r[0] for r in patterns.collect()))
        keyed = docs.withColumn("common", F.array().cast("array<bigint>"))
    else:
        # each document with those of its own forms that are furniture
        shared = spark.sparkContext.broadcast(frozenset())
        edges = T.StructType([T.StructField("doc_no", T.LongType()), T.StructField("pattern", T.LongType())])
        own = _map(docs.select("doc_no", "pages"), lambda r: ((r["doc_no"], p) for p in edge_patterns(r["pages"])[0]), edges)
        keyed = docs.join(own.join(patterns, "pattern", "left_semi").groupBy("doc_no").agg(F.collect_set("pattern").alias("common")), "doc_no", "left")

    def rows(documents: Iterator[dict]) -> Iterator[tuple]:
        sure: Counter = Counter()
        every: Counter = Counter()
        for r in documents:
            laid = layout(r["pages"], r["name"], shared.value.union(r["common"]) if r["common"] else shared.value)
            own = text_lines(laid)
            a, b, words = lexicon_counts(own, layer_pages(r["pages"], r["ocr_pages"]))
            sure.update(a)
            every.update(b)
            yield r["scan_id"], r["doc_no"], [dict(page_no=p, line_no=k, text=x, header=h, pageno=n) for p, k, x, h, n in laid], words, None
            if len(every) > 200_000:
                yield None, None, None, None, [dict(entry=k, sure=sure[k], every=n) for k, n in every.items()]
                sure.clear()
                every.clear()
        if every:
            yield None, None, None, None, [dict(entry=k, sure=sure[k], every=n) for k, n in every.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = (r for b in batches for a in range(0, b.num_rows, 256) for r in b.slice(a, 256).to_pylist())
        yield from _batches(rows(documents), _LINES, 256)

    return written(keyed.mapInArrow(run, _LINES))


def _with_fold(counted: DataFrame) -> DataFrame:
    schema = T.StructType([*_COUNT.fields, T.StructField("folded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fold(x) if not x.startswith("#") else x for x in b.column(0).to_pylist()], pa.string())], names=schema.names)

    return counted.select(*_COUNT.names).mapInArrow(run, schema)


def _links(lexicon: DataFrame) -> DataFrame:
    """``entry, word, ratio, backed, strong``: rare words with each frequent one of which plausible glyph edits make them.

    A rare word meets every entry of its folded spelling that is frequent enough beside it, and the edits are checked for each. ``backed``: only the
    frequent one is on pages with a text layer. ``strong``: the frequencies alone speak for it.
    """
    words = lexicon.where(~F.col("entry").startswith("#") & F.col("entry").rlike(r"[^\W\d_]")).select("entry", "sure", "every", "folded")
    leaders = words.select("folded", *(F.col(c).alias(f"lead_{c}") for c in ("entry", "sure", "every"))).where(F.col("every") >= RATIO_BACKED)
    ratio = F.col("lead_every") / F.col("every")
    backed = (F.col("sure") == 0) & (F.col("lead_sure") > 0)
    real = F.col("sure") * RATIO > F.col("lead_sure")
    met = words.join(leaders, "folded").where((F.col("lead_entry") != F.col("entry")) & (ratio >= RATIO_BACKED) & ~real)
    good = met.where(_plausible_udf()("entry", "lead_entry"))
    return good.select("entry", F.col("lead_entry").alias("word"), F.col("lead_every").alias("word_n"), ratio.alias("ratio"), backed.alias("backed"), ((ratio >= RATIO) | backed).alias("strong"))


def _corrections(lexicon: DataFrame, likeness: DataFrame | None = None) -> DataFrame:
    """``entry, choices``: rare words with the frequent ones that they may stand for, the most frequent first, each with how many times as frequent it is.

    With ``likeness`` (``_likeness``) they have what ``choose`` weighs at each occurrence; without it frequencies alone tell.
    """
    fields = ["word", "ratio"] if likeness is None else ["word", "ratio", "backed", "like", "gap", "tell", "vector"]
    found = _links(lexicon).where("strong") if likeness is None else likeness
    # the least of what is sorted comes first: the most frequent, ties by spelling
    choice = F.struct((-F.col("word_n")).alias("n"), *fields)
    return found.groupBy("entry").agg(F.transform(F.array_sort(F.collect_list(choice)), lambda x: F.struct(*(x[f] for f in fields))).alias("choices"))


def _plausible_udf():
    """Whether glyph edits make a word of another, few for its length."""

    @F.pandas_udf("boolean")
    def plausible(entry, lead):  # noqa: ANN001, ANN202
        import pandas as pd

        found = ((e, edits(x, e)) for e, x in zip(entry, lead))
        return pd.Series([n is not None and 0 < n <= 1 + len(e) // 5 for e, n in found], dtype=bool)

    return plausible


def _vectors(lines: DataFrame, lexicon: DataFrame) -> tuple[list[str], np.ndarray]:
    """Skip-gram vectors of the most frequent words of the text: the words, and a matrix without what all vectors share.

    Frequent words are thinned out in training as published for it (each occurrence stays with the root of THINNING over the word's share); which
    occurrences go depends on document and place only, so every run sees the same.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    usual = lexicon.where(F.col("every") >= VOCABULARY_LEAST)
    n = usual.count()
    none = ([], np.zeros((0, VECTOR_SIZE), np.float32))
    if not n:
        return none
    least = VOCABULARY_LEAST
    if n > VOCABULARY_MOST:
        least = usual.select("every").orderBy(F.desc("every")).offset(VOCABULARY_MOST).first()[0] + 1
    known = usual.where(F.col("every") >= least).select("entry", "every").toPandas()  # VOCABULARY_MOST rows at most
    total = lexicon.agg(F.sum("every")).first()[0]
    share = dict(zip(known["entry"], known["every"] / total))
    stays = lines.sparkSession.sparkContext.broadcast(share)
    schema = T.StructType([T.StructField("words", T.ArrayType(T.StringType()))])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(1)
            flat = words.flatten().dictionary_encode()
            part = np.array([stays.value.get(w, 0.0) for w in flat.dictionary.to_pylist()] or [0.0])
            keep = np.where(part > 0, np.sqrt(THINNING / np.maximum(part, THINNING)), 0.0)
            sizes = np.diff(words.offsets.to_numpy())
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            seed = np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), sizes)
            drawn = (seed + np.arange(len(flat), dtype=np.uint64) - first.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            drawn = ((drawn ^ (drawn >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(11)
            codes = flat.indices.to_numpy(zero_copy_only=False)
            stay = (drawn.astype(np.float64) / 2.0**53 < keep[codes]) if len(codes) else np.zeros(0, bool)
            ends = np.concatenate(([0], np.cumsum(stay)))[np.concatenate(([0], np.cumsum(sizes)))]
            left = pa.DictionaryArray.from_arrays(pa.array(codes[stay]), flat.dictionary).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), left)], names=["words"])

    sentences = lines.select("doc_no", F.coalesce("words", F.array().cast("array<string>")).alias("words")).mapInArrow(thin, schema).where(F.size("words") > 1)
    sentences = cut(sentences)
    if sentences.isEmpty():
        return none
    parts = max(1, min(64, sentences.rdd.getNumPartitions()))
    # the vocabulary is what is left of the words chosen above
    model = Word2Vec(vectorSize=VECTOR_SIZE, windowSize=CONTEXT_WINDOW, minCount=1, numPartitions=parts, maxIter=1, seed=7, inputCol="words", outputCol="v", maxSentenceLength=400).fit(sentences)
    got = model.getVectors().select("word", vector_to_array("vector", "float32").alias("vector")).toPandas()
    m = np.array(got["vector"].tolist(), np.float64).reshape(-1, VECTOR_SIZE)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    weight = np.array([share.get(w, 0.0) for w in got["word"]])
    return list(got["word"]), (m - (weight @ m) / max(weight.sum(), 1e-12)).astype(np.float32)


def surroundings(ids: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each place of a text the sum of the vectors (rows of ``m``) of the words around it; an id of -1 has none."""
    x = np.where((ids >= 0)[:, None], m[ids], 0.0) if len(m) else np.zeros((len(ids), m.shape[1]))
    run = np.vstack([np.zeros((1, x.shape[1])), x.cumsum(0, dtype=np.float64)])
    at = np.arange(len(ids))
    return run[np.minimum(len(ids), at + CONTEXT_WINDOW + 1)] - run[np.maximum(0, at - CONTEXT_WINDOW)] - x


class _Sums:
    """Sums of vectors by word over one half of the documents, handed on as they fill."""

    def __init__(self, half: int, most: int = 50_000):
        self.half, self.most, self.at = half, most, {}
        self.sums, self.counts = np.zeros((1024, VECTOR_SIZE)), np.zeros(1024, np.int64)

    def add(self, words: list[str], vectors: np.ndarray) -> None:
        slots = np.fromiter((self.at.setdefault(w, len(self.at)) for w in words), np.int64, len(words))
        if len(self.at) > len(self.counts):
            grown = max(len(self.at), 2 * len(self.counts)) - len(self.counts)
            self.sums, self.counts = np.pad(self.sums, ((0, grown), (0, 0))), np.pad(self.counts, (0, grown))
        order = np.argsort(slots, kind="stable")
        first = np.flatnonzero(np.diff(slots[order], prepend=-1))
        self.sums[slots[order][first]] += np.add.reduceat(vectors[order], first, axis=0)
        self.counts[slots[order][first]] += np.diff(np.append(first, len(order)))

    def rows(self) -> Iterator[tuple]:
        for w, i in self.at.items():
            yield None, None, None, None, self.half, None, "context", w, None, None, None, None, None, None, int(self.counts[i]), self.sums[i].tolist()
        self.__init__(self.half, self.most)


def _read(lines: DataFrame, links: DataFrame, vectors: tuple[list[str], np.ndarray]) -> DataFrame:
    """Tokens that may be misread and words at line ends that may be broken, with what the decision needs; and every word's sum of surroundings (``context``).

    Words of the vocabulary that are no one's misreading are left out at the source; what else is not suspect goes when it meets the links.
    """
    spark = lines.sparkSession
    sc = spark.sparkContext
    spoken = {w: i for i, w in enumerate(vectors[0])}
    named = spark.createDataFrame([(w,) for w in vectors[0]], "entry string")
    suspect = {r[0] for r in named.join(links, "entry", "left_semi").collect()}  # words of the vocabulary, a bounded list
    shared = sc.broadcast((spoken, frozenset(w for w in spoken if w not in suspect), vectors[1]))

    def rows(documents: Iterator[dict]) -> Iterator[tuple]:
        index, known, m = shared.value
        halves = (_Sums(0), _Sums(1))
        for r in documents:
            own = [(x["page_no"], x["line_no"], x["text"]) for x in r["lines"] if not (x["header"] or x["pageno"])]
            tokens = [x.split() for _, _, x in own]
            keys = [[key_of(t) for t in ts] for ts in tokens]
            flat = [k for ks in keys for k in ks]
            if not flat:
                continue
            around = surroundings(np.fromiter((index.get(k, -1) for k in flat), np.int64, len(flat)), m)
            sums = halves[r["doc_no"] & 1]
            sums.add(flat, around)
            if len(sums.at) > sums.most:
                yield from sums.rows()
            carry, at = False, 0
            for i, (p, k, line) in enumerate(own):
                end = _ends_broken(line) if i + 1 < len(own) else None
                here = len(tokens[i])
                for j in range(1 if carry else 0, here - 1 if end else here):
                    e = keys[i][j]
                    if e and e not in known and e != "#":
                        yield r["scan_id"], r["doc_no"], p, k, j + 1, tokens[i][j], "word", e, numeric_fix(tokens[i][j]), None, None, None, None, None, None, around[at + j].tolist()
                at += here
                carry = end is not None
                if end:
                    (np_, nk, _), right = own[i + 1], tokens[i + 1][0]
                    left, sign = end
                    both = (around[at - 1] + around[at]).tolist()
                    yield r["scan_id"], r["doc_no"], p, k, here, left + "\n" + right, "broken", key_of(left + right), key_of(left + "-" + right), len(left.lstrip(OUTER)), np_, nk, sign, key_of(left) in index and key_of(right) in index, None, both
        for sums in halves:
            yield from sums.rows()

    return _stream(lines.select("scan_id", "doc_no", "lines"), rows, _READ)


def _likeness(links: DataFrame, read: DataFrame, vectors: tuple[list[str], np.ndarray]) -> tuple[DataFrame, np.ndarray]:
    """``links`` with how much alike the surroundings of both words are (``like``), how much less than those of the nearest frequent word (``gap``), and the frequent word's own ``vector``.

    Also the vectors of the frequent words, those that are no one's misreading. ``tell`` says from 0 to 1 how much surroundings tell in these documents at all: how alike those of the same word are in one half of them and in the other.
    """
    spark = links.sparkSession
    total = lambda when: F.array(*(F.coalesce(F.sum(F.when(when, F.col("around")[i])), F.lit(0.0)).cast("float") for i in range(VECTOR_SIZE)))
    half = F.col("token_no")
    context = cut(read.where("kind = 'context'").groupBy("entry").agg(F.sum("n").alias("n"), total(F.lit(True)).alias("vector"), total(half == 0).alias("even")))
    words = spark.createDataFrame([(w,) for w in vectors[0]], "entry string")
    usual = context.join(words, "entry").join(links.select("entry").distinct(), "entry", "left_anti").select("n", "vector", "even").toPandas()  # one row per word of the vocabulary
    near, even = (np.array(usual[c].tolist(), np.float32).reshape(-1, VECTOR_SIZE) for c in ("vector", "even"))
    agree = (_units(even) * _units(near - even)).sum(1)
    tell = max(0.0, float(np.average(agree, weights=usual["n"]))) if len(usual) else 0.0
    wide = len(links.columns)
    frequent = spark.sparkContext.broadcast(_units(near))
    context = context.select("entry", "vector")
    met = links.join(context.withColumnRenamed("vector", "own"), "entry", "left").join(context.withColumnRenamed("entry", "word"), "word", "left")
    schema = T.StructType([*(links.schema[c] for c in links.columns), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("like", T.DoubleType()), T.StructField("gap", T.DoubleType()), T.StructField("tell", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(column: pa.Array) -> np.ndarray:
            return _units(np.array([v or [0.0] * VECTOR_SIZE for v in column.to_pylist()], np.float32).reshape(-1, VECTOR_SIZE))

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                b = batch.slice(a, 512)
                u, v = matrix(b.column(wide)), matrix(b.column(wide + 1))
                like = (u * v).sum(1).astype(np.float64)
                best = (u @ frequent.value.T).max(1) if len(frequent.value) else np.zeros(len(u))
                gap = np.maximum(best - like, 0.0)
                yield pa.RecordBatch.from_arrays([*b.columns[: wide], pa.array(list(v), pa.list_(pa.float32())), pa.array(like), pa.array(gap.astype(np.float64)), pa.array([tell] * len(gap), pa.float64())], names=schema.names)

    return met.select(*links.columns, "own", "vector").mapInArrow(run, schema), frequent.value


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def choose(choices: list[dict], around: list[float] | None, frequent: np.ndarray) -> str | None:
    """The linked word that an occurrence stands for; None if it is the misreading of none.

    A linked word must be a neighbour: what surrounds the rare word, all over or here, must be about as much like the word's surroundings as like those of
    the nearest of the ``frequent`` words. There must be evidence enough by frequencies and likeness; the best for the place is taken.
    """
    context = np.asarray(around if around is not None else [0.0] * VECTOR_SIZE)
    context = context / max(float(np.linalg.norm(context)), 1e-12)
    best = float((frequent @ context).max()) if len(frequent) else 0.0
    found, most = None, -math.inf
    for c in choices:
        here, tell = float(np.dot(c["vector"], context)), c["tell"]
        if tell * min(c["gap"], max(0.0, best - here)) > NEAR_GAP:
            continue
        evidence = math.log(c["ratio"]) + BACKED_WEIGHT * c["backed"]
        if evidence + LIKENESS_WEIGHT * tell * max(c["like"], here) < math.log(RATIO) + EVIDENCE_MORE * tell - 1e-9:
            continue
        if evidence + LIKENESS_WEIGHT * tell * here > most:
            found, most = c["word"], evidence + LIKENESS_WEIGHT * tell * here
    return found


_DECIDED = T.StructType(
    [T.StructField("scan_id", T.LongType()), T.StructField("doc_no", T.LongType()), T.StructField("page_no", T.IntegerType()), T.StructField("line_no", T.IntegerType()), T.StructField("token_no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("fixed", T.StringType())]
)


def decide(model: ScanModel) -> DataFrame:
    """``scan_id, doc_no, page_no, line_no, token_no, kind, fixed``: each broken word (``hyphen``) and misread token (``misread``) of the text.

    ``fixed`` is the token as it should read; of a broken word the whole word, null where it is only misread on that line.
    """
    lex = model.lexicon.select("entry", F.struct("sure", "every").alias("n"))
    by_fold = model.lexicon.where(~F.col("entry").startswith("#")).groupBy("folded").agg(F.max_by("entry", "every").alias("lead"), F.max("every").alias("lead_n"))
    with_counts = (
        model.suspects.withColumn("folded", _fold_udf()(F.col("entry")))
        .join(lex.select("entry", F.col("n").alias("n_entry")), "entry", "left")
        .join(lex.select(F.col("entry").alias("other"), F.col("n").alias("n_other")), "other", "left")
        .join(by_fold, "folded", "left")
        .join(model.corrections, "entry", "left")
    )

    shared = model.lines.sparkSession.sparkContext.broadcast(model.frequent)

    # parts of broken words as words of their own
    def rows(r: dict) -> Iterator[tuple]:
        n = r["n_entry"]["every"] if r["n_entry"] else 0
        o = r["n_other"]["every"] if r["n_other"] else 0
        head = (r["scan_id"], r["doc_no"])
        if r["kind"] == "word":
            here = (*head, r["page_no"], r["line_no"], r["token_no"], "misread")
            if r["other"] is not None and o >= RATIO_BACKED * max(n, 1) and not (r["n_entry"] and r["n_entry"]["sure"]):
                yield (*here, _as_digits(r["token"]))
            elif r["choices"]:
                word = choose(r["choices"], r["around"], shared.value)
                if word is not None:
                    yield (*here, _like(r["token"], word))
            return
        left, right = r["token"].split("\n")
        fold_n = r["lead_n"] or 0
        compound = o > n and o >= 1
        if compound:
            return
        plain = r["sign"] in PLAIN_HYPHENS
        if n == 0 and fold_n == 0 and plain:
            # nothing known of the whole: a word goes on in lower case after a part that is no word
            if not right[:1].islower() or key_of(left).startswith("#"):
                return
            if r["parts_known"]:
                return
        yield (*head, r["page_no"], r["line_no"], r["token_no"], "hyphen", None if n else r["lead"])
        fixed = None
        if r["choices"]:
            fixed = choose(r["choices"], r["around"], shared.value)
        elif n == 0 and fold_n >= RATIO_BACKED and not r["entry"].startswith("#"):
            fixed = r["lead"]
        if fixed and fixed != r["entry"]:
            for side in _sides(r["entry"], fixed, r["cut_at"]):
                if side == 0:
                    yield (*head, r["page_no"], r["line_no"], r["token_no"], "misread", None)
                else:
                    yield (*head, r["next_page"], r["next_line"], 1, "misread", None)

    return _map(with_counts, rows, _DECIDED)


def _fold_udf():
    @F.pandas_udf("string")
    def folded(s):  # noqa: ANN001, ANN202
        return s.map(lambda x: None if x is None else x if x.startswith("#") else fold(x))

    return folded


def _as_digits(token: str) -> str:
    core = bare(token)
    fixed = list(core)
    for i, c in enumerate(core):
        if (c.isalpha() or c in "|!") and ((i and fixed[i - 1].isdigit()) or (i + 1 < len(core) and core[i + 1].isdigit())):
            d = c.translate(DIGITS)
            fixed[i] = d if d.isdigit() else c
    return token.replace(core, "".join(fixed), 1)


def _like(token: str, word: str) -> str:
    """``word`` with the case and the outer punctuation of ``token``."""
    core = bare(token)
    if sum(c.isupper() for c in core) > 1 and not any(c.islower() for c in core):
        word = word.upper()
    elif core[:1].isupper():
        word = word[:1].upper() + word[1:]
    return token.replace(core, word, 1)


def _sides(read: str, right: str, cut_at: int) -> set[int]:
    """On which sides of ``cut_at`` the two spellings differ."""
    a = 0
    while a < min(len(read), len(right)) and read[a] == right[a]:
        a += 1
    b = 0
    while b < min(len(read), len(right)) - a and read[-1 - b] == right[-1 - b]:
        b += 1
    out = set()
    if a < cut_at:
        out.add(0)
    if len(read) - b > cut_at:
        out.add(1)
    return out or {0}


def defects(model: ScanModel) -> DataFrame:
    """``scan_id, page_no, line_no, kind``: one row for each line and kind of defect (header, pageno, hyphen, misread)."""
    line = model.lines.select("scan_id", F.explode("lines").alias("x"))
    marks = line.select("scan_id", "x.page_no", "x.line_no", F.explode(F.array_compact(F.array(F.when(F.col("x.header"), "header"), F.when(F.col("x.pageno"), "pageno")))).alias("kind"))
    return marks.unionByName(decide(model).select("scan_id", "page_no", "line_no", "kind")).distinct()


_PARAGRAPHS = T.StructType([T.StructField("scan_id", T.LongType()), T.StructField("para_no", T.IntegerType()), T.StructField("first_page", T.IntegerType()), T.StructField("text", T.StringType())])


def paragraphs(model: ScanModel) -> DataFrame:
    """``scan_id, para_no, first_page, text``: the text of each document repaired and reflowed.

    Furniture is gone, broken words are whole and misread ones corrected. A blank line, an indented line or a line of its own (a heading, a short line that ends
    a sentence before a new one) ends a paragraph; the end of a page does not.
    """
    fixes = decide(model).groupBy("scan_id", "doc_no").agg(F.collect_list(F.struct("page_no", "line_no", "token_no", "kind", "fixed")).alias("fixes"))
    joined = model.lines.join(fixes, ["scan_id", "doc_no"], "left")

    def rows(r: dict) -> Iterator[tuple]:
        for n, (page, text) in enumerate(reflow([(x["page_no"], x["line_no"], x["text"]) for x in r["lines"] if not (x["header"] or x["pageno"])], r["fixes"] or []), 1):
            yield r["scan_id"], n, page, text

    return _map(joined, rows, _PARAGRAPHS)


def reflow(lines: list[tuple[int, int, str]], fixes: list[dict]) -> Iterator[tuple[int, str]]:
    """Paragraphs of text lines (page, line number, text) after the fixes."""
    words: dict[tuple[int, int, int], str] = {(f["page_no"], f["line_no"], f["token_no"]): f["fixed"] for f in fixes if f["kind"] == "misread" and f["fixed"]}
    broken = {(f["page_no"], f["line_no"]): f["fixed"] for f in fixes if f["kind"] == "hyphen"}
    width = max((len(x.rstrip()) for _, _, x in lines), default=0)
    para: list[str] = []
    start = 0
    last: tuple[int, int, str] | None = None
    joined = False
    lead: str | None = None
    for page, no, line in lines:
        tokens = [words.get((page, no, j), t) for j, t in enumerate(line.split(), 1)]
        if last is not None and para and not joined:
            gap = last[0] == page and no > last[1] + 1
            indented = line[:1].isspace() and len(line) - len(line.lstrip()) >= 2
            short = len(last[2].rstrip()) + 1 + len(tokens[0]) <= width - 1 and (bool(re.search(r"[.!?:»”\")]\s*$", last[2])) or len(last[2].split()) <= 5) and not tokens[0][:1].islower()
            if gap or indented or short:
                yield start, " ".join(para)
                para = []
        if not para:
            start = page
        if joined and para:
            whole = lead
            if whole:
                tail = tokens[0][len(tokens[0].rstrip(OUTER + "!")) :]
                para[-1] = _like(para[-1], whole) + tail
            else:
                para[-1] += tokens[0]
            tokens = tokens[1:]
        joined = (page, no) in broken
        lead = broken.get((page, no))
        if joined and tokens:
            tokens[-1] = tokens[-1].rstrip(HYPHENS)
        para.extend(tokens)
        last = (page, no, line)
    if para:
        yield start, " ".join(para)
