import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lensframe.operators.packed import split_array, split_packed, split_text


def brute(text):
    """The rule by a state machine over characters, for ids and double-quoted names."""
    if text is None:
        return []
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i] == '"':
            j = i + 1
            while j < n and not (text[j] == '"' and text[j + 1 : j + 2] != '"'):
                j += 2 if text[j] == '"' else 1
            if j < n:
                body = text[i + 1 : j]
                if re.search("[A-Za-z]", re.sub(r"\b(and|null|none|n/a)\b", "", body)):
                    out.append(body.replace('""', '"').strip())
                else:
                    out += re.findall(r"\d+", body)
                i = j + 1
                continue
        m = re.match(r"\d+", text[i:])
        if m:
            out.append(m.group())
            i += m.end()
        else:
            i += 1
    return out


@pytest.mark.parametrize(
    "text,values",
    [
        ("1;2", ["1", "2"]), (";1;;2;", ["1", "2"]), ("", []), (None, []), ("  ", []), ("n/a", []), ("--;7", ["7"]), ("1 2\t3\n4", ["1", "2", "3", "4"]), ("[1、2；3]", ["1", "2", "3"]),
        ('"1;2"', ["1", "2"]), ('"1 and 2"', ["1", "2"]), ('"Pump, lift 3";4', ["Pump, lift 3", "4"]), ('"Valve 8"" main"', ['Valve 8" main']), ("'5';'6'", ["5", "6"]), ("1;1", ["1", "1"]), ('"Well & tree" & 9', ["Well & tree", "9"]),
        ("1/n/a/2", ["1", "2"]), ('"a;b', ["a", "b"]), ('""', []), ("'Pump 3';12", ["Pump 3", "12"]), ("O'Neil; 5", ["O'Neil", "5"]), ("1 and '2' and 3", ["1", "2", "3"]), ("\x1e1", ["1"]), ("(4 | 5)", ["4", "5"]),
    ],
)
def test_fixed_cases(text, values):
    assert split_text(text) == values


@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["12", "7", ";", ",", " ", "/", '"Riser 5"', '"A ""b"" c"', "\n", "、", " and ", "null", "[", "]", "'3'", '"4;5"'])).map(lambda x: ";".join(x))), max_size=20))
@settings(max_examples=150, deadline=None)
def test_against_state_machine(texts):
    got = split_array(pa.array(texts, pa.string())).to_pylist()
    assert got == [brute(t) for t in texts]


def test_rows_positions_and_clashes(spark):
    df = spark.createDataFrame([(1, "5;6", "x"), (2, None, "y"), (3, "", None), (1, "5;6", "x"), (4, "7;" * 50_000, "long")], "id int, refs string, pos string")
    out = split_packed(df, "refs")
    assert out.columns == ["id", "pos", "value"]
    rows = [tuple(r) for r in out.collect()]
    assert rows.count((1, 1, "5")) == 2 and (1, 2, "6") in rows
    assert sum(r[0] == 4 for r in rows) == 50_000 and max(r[1] for r in rows) == 50_000
    with pytest.raises(ValueError):
        split_packed(df, "refs", keep=["id", "pos"])
    assert split_packed(df.limit(0), "refs").count() == 0


def test_sliced_arrays():
    a = pa.array(["1;2", None, '"x;y"', "3"])
    assert split_array(a.slice(1)).to_pylist() == [[], ["x;y"], ["3"]]
