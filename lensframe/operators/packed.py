"""Several values packed in one field: one row per value, with its place.

The work is done on the byte buffer of an Arrow string column: masks for delimiters, quote parity
and empty words over all bytes of a batch, then child offsets, a list array, and its flattening with
the ordinals of the parents. No Python loop runs over rows or bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates values, and what stands for no value.
HARD = (";", ",", "|", "/", "&", "\t", "\n", "\r", "\v", "\f", "；", "，", "、", "｜", "／", "＆", "､")
BLANK = (" ", "\u00a0", "\u3000", "\u2009", "\u202f", "\ufeff")
BRACKETS = "[]{}()<>"
JOINERS = ("and", "und", "og", "AND")
NOTHING = ("n/a", "N/A", "n.a.", "N.A.", "na", "NA", "none", "None", "NONE", "null", "Null", "NULL", "nil", "NIL", "nan", "NaN", "-", "--", "---", "?", "??", "–", "—", ".", "#N/A", "unknown", "UNKNOWN")


def _find(data: np.ndarray, word: bytes) -> np.ndarray:
    """Starts of ``word`` in ``data``."""
    n = len(data) - len(word) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at = np.flatnonzero(data[:n] == word[0])
    for k in range(1, len(word)):
        at = at[data[at + k] == word[k]]
    return at


def _spread(at: np.ndarray, width: int, mask: np.ndarray) -> None:
    for k in range(width):
        mask[at + k] = True


def _per_run(flag: np.ndarray, run: np.ndarray, runs: int) -> np.ndarray:
    """For each run number whether ``flag`` holds anywhere in it."""
    return np.bincount(run[flag], minlength=runs) > 0


def split_array(column: pa.Array) -> pa.ListArray:
    """The values of each text of ``column``; a null or empty text gives an empty list."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(text)
    if not n:
        return pa.array([], pa.list_(pa.string()))
    # a separator of our own closes each row, so that no run crosses rows; then the bytes are read in place
    closed = pc.binary_join_element_wise(text, pa.scalar("", pa.large_string()), pa.scalar("\x1e", pa.large_string()))
    at = np.frombuffer(closed.buffers()[1], np.int64)[closed.offset : closed.offset + n + 1]
    data = np.frombuffer(closed.buffers()[2], np.uint8)[at[0] : at[-1]]
    first, ends = at[:-1] - at[0], at[1:] - at[0] - 1
    lengths = ends - first
    row_end = np.zeros(len(data), bool)
    row_end[ends] = True

    hard, blank, other = row_end.copy(), np.zeros(len(data), bool), np.zeros(len(data), bool)
    for c in (*HARD, *BRACKETS):
        b = c.encode()
        _spread(_find(data, b), len(b), hard)
    for c in BLANK:
        b = c.encode()
        _spread(_find(data, b), len(b), blank)
    quote = data == 34
    apostrophe = data == 39

    # quote parity within the row
    seen = np.cumsum(quote)
    before = np.repeat(np.concatenate(([0], seen))[first], lengths + 1)
    inside = ((seen - before) % 2 == 1) & ~row_end
    in_quotes = inside | quote
    # a doubled quote leaves and enters at once: one stretch from the opening to the closing quote
    stretch = np.cumsum(np.diff(in_quotes, prepend=False) & in_quotes)

    # words for nothing, and words that join, where they stand alone; they act as delimiters
    digit = (data >= 48) & (data <= 57)
    edge = hard | blank | quote | apostrophe
    words = np.zeros(len(data), bool)
    for word in sorted((*NOTHING, *JOINERS), key=len, reverse=True):
        b = word.encode()
        at = _find(data, b)
        if len(at):
            alone = edge[np.minimum(at + len(b), len(data) - 1)] & ((at == 0) | edge[np.maximum(at - 1, 0)])
            _spread(at[alone], len(b), words)
    other = ~(digit | edge | words)
    # one between letters or digits is part of a word
    apostrophe &= np.concatenate(([True], edge[:-1])) | np.concatenate((edge[1:], [True]))

    # quoted stretches that hold more than ids are names: one value whatever they contain
    runs = int(stretch[-1]) + 1 if len(data) else 1
    is_name = _per_run(in_quotes & other, stretch, runs)
    # an unclosed quote at the row's end is a plain sign
    open_row = np.repeat((seen[ends] - before[ends]) % 2 == 1, lengths + 1)
    name = in_quotes & is_name[stretch] & ~open_row

    # the same for single quotes around text, where they open after a delimiter and close before one
    if (apostrophe & ~name).any():
        name = _single_quotes(name, apostrophe, other, first, lengths)

    split = (hard | quote | apostrophe | words) & ~name
    # blanks separate ids but not the words of a text that nothing quotes
    chunk = np.cumsum(split)
    wordy = _per_run(other & ~name & ~split, chunk, int(chunk[-1]) + 1)
    split |= blank & ~name & ~wordy[chunk]
    split |= row_end

    value = ~split
    start = np.flatnonzero(value & ~np.concatenate(([False], value[:-1])) | (name & ~np.concatenate(([False], name[:-1]))))
    stop_mask = np.zeros(len(data) + 1, bool)
    edges = np.flatnonzero(np.diff(np.concatenate((value, [False])).astype(np.int8)) == -1) + 1
    stop_mask[edges] = True
    stop_mask[start[1:][value[start[1:] - 1]]] = True if len(start) > 1 else False
    leave = np.flatnonzero(name[:-1] & ~name[1:] & value[1:]) + 1
    if len(leave):  # text straight after a closing quote begins a value of its own
        start = np.union1d(start, leave)
        stop_mask[leave] = True
    stop = np.flatnonzero(stop_mask)
    if not len(start):
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))

    keep = np.flatnonzero(value)
    sizes = stop - start
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    body = np.ascontiguousarray(data[keep])
    tokens = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(body))
    named = pa.array(name[start])
    if pc.any(named).as_py():
        bare = pc.replace_substring_regex(tokens, r'^["\']|["\']$', "")
        bare = pc.replace_substring(bare, '""', '"')
        tokens = pc.if_else(named, bare, tokens)
    tokens = pc.utf8_trim_whitespace(tokens)
    tokens = pc.utf8_trim(tokens, "".join(BLANK))
    row = np.searchsorted(first, start, side="right") - 1
    filled = pc.greater(pc.binary_length(tokens), 0).to_numpy(zero_copy_only=False)
    # a quoted or bare word for nothing is no value
    filled &= ~pc.is_in(tokens, pa.array(NOTHING, pa.large_string())).to_numpy(zero_copy_only=False)
    tokens, row = tokens.filter(pa.array(filled)), row[filled]
    per_row = np.bincount(row, minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)), tokens.cast(pa.string()))


def _single_quotes(name: np.ndarray, apostrophe: np.ndarray, other: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Marks single-quoted stretches that hold text as names, by parity outside double-quoted names."""
    q = apostrophe & ~name
    seen = np.cumsum(q)
    base = np.repeat(np.concatenate(([0], seen))[first], lengths + 1)
    inside = (seen - base) % 2 == 1
    closed = np.repeat((seen[first + lengths] - base[first + lengths]) % 2 == 0, lengths + 1)
    in_q = (inside | q) & closed
    stretch = np.cumsum(np.diff(in_q, prepend=False) & in_q)
    holds = _per_run(in_q & other & ~name, stretch, int(stretch[-1]) + 1)
    return name | (in_q & holds[stretch])


def split_text(text: str | None) -> list[str]:
    """``split_array`` on one text."""
    return split_array(pa.array([text], pa.string()))[0].as_py()


def split_packed(df: DataFrame, column: str, keep: Iterable[str] | None = None, value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per value of ``column`` with ``keep`` (default: the other columns), ``pos`` and ``value``.

    A value is an id (or any text without delimiters) or a quoted name; a name is one value whatever it
    contains, while ids are separate values even if quotes enclose the lot. Quotes, brackets and outer
    blanks go; a doubled quote in a name is one quote. Empty places and words for nothing are no values and
    take no position. Repeated values stay. Null, empty and blank fields give no row; an unclosed quote is
    an ordinary sign. Columns of ``df`` named like ``value`` or ``pos`` must be left out of ``keep``.
    A narrow operation: no shuffle, and a row's size is bounded by its field.
    """
    keep = [c for c in df.columns if c not in (column, value, pos)] if keep is None else list(keep)
    clash = {value, pos} & set(keep)
    if clash:
        raise ValueError(f"kept columns clash with the result's: {sorted(clash)}")
    source = df.where(F.col(column).isNotNull()).select(*keep, F.col(column).cast("string").alias("__packed"))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(pos, T.IntegerType()), T.StructField(value, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = split_array(batch.column(batch.num_columns - 1))
            parent = pc.list_parent_indices(lists)
            starts = lists.offsets.to_numpy()[:-1]
            at = parent.to_numpy(zero_copy_only=False)
            ordinal = np.arange(len(at)) - starts[at] + 1
            out = [batch.column(i).take(parent) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(ordinal.astype(np.int32)), lists.flatten()], names=[*keep, pos, value])

    return source.mapInArrow(run, schema)
