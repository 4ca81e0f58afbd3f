import datetime as dt

from lensframe.operators import drift

COLS = "file_id bigint, uidlog string, dtimcreation timestamp, curve_no int, uid string, mnemonic string, curvedescription string, unit string, typelogdata string, extra string"


def rows(log, file_id, day, curves):
    return [(file_id, log, dt.datetime(2020, 1, 1) + dt.timedelta(days=day), i, *c, None) for i, c in enumerate(curves, 1)]


def changes(spark, data):
    return sorted(tuple(r) for r in drift.changes(spark.createDataFrame(data, COLS)).collect())


def c(uid, m, d="", u="", k="double"):
    return (uid, m, d, u, k)


def test_steady_uids_tell(spark):
    data = rows("L", 9, 0, [c("k1", "MD", "depth"), c("k2", "GR", "gamma")]) + rows("L", 2, 40, [c("K1", " depth ", "depth"), c("k2", "gr", "gamma", "", "long"), c("k3", "GR2", "gamma")]) + rows("L", 5, 90, [c("k3", "GR2", "gamma", "", None)])
    assert changes(spark, data + data[:2]) == [("L", 2, "added", "GR2"), ("L", 2, "renamed", "DEPTH"), ("L", 2, "retyped", "GR"), ("L", 5, "removed", "DEPTH"), ("L", 5, "removed", "GR")]


def test_names_and_meanings_tell_where_uids_do_not(spark):
    a = [c("c1", "MD", "Measured depth"), c("c2", "GR", "Gamma ray"), c("c3", "TG", "Total gas")]
    b = [c("c1", "MD", "measured depth"), c("c2", "TG", "Total gas"), c("c3", "HGR", "corrected gamma ray curve"), c("c4", "ROP", "Rate of penetration")]
    assert changes(spark, rows("P", 1, 0, a) + rows("P", 2, 1, b)) == [("P", 2, "added", "ROP"), ("P", 2, "renamed", "HGR")]
    same = [c(x[1], *x[1:]) for x in a]
    assert changes(spark, rows("M", 1, 0, same) + rows("M", 2, 1, same[::-1])) == []


def test_nulls_single_files_and_empty(spark):
    assert changes(spark, rows("L", 1, 0, [c("k1", "A")])) == []
    assert changes(spark, [(None, "L", None, None, None, None, None, None, None, None), (1, None, None, None, "k", "A", None, None, None, None)]) == []
    assert drift.changes(spark.createDataFrame([], COLS)).count() == 0
    # a file without a time comes first
    data = rows("L", 7, 3, [c("k1", "A"), c("k2", "B"), c("k4", "D")]) + [(8, "L", None, i, u, m, "", "", "double", None) for i, (u, m) in enumerate([("k1", "A"), ("k2", "B")], 1)]
    assert changes(spark, data) == [("L", 7, "added", "D")]


def test_lattice_and_unified_rows(spark):
    data = rows("L", 1, 0, [c("k1", "MD", k="long"), c("k2", "T", k="date time"), c("k3", "N", k="string")]) + rows("L", 2, 1, [c("k1", "MD", k="double"), c("k2", "T", k="string"), c("k3", "N", k=None)])
    curves = spark.createDataFrame(data, COLS)
    assert {(r.mnemonic, r.kind) for r in drift.union_schema(curves).collect()} == {("MD", "double"), ("T", "string"), ("N", "string")}
    lines = spark.createDataFrame([(1, 1, "5, 2020-01-01T00:00:00Z , a"), (1, 1, "5, 2020-01-01T00:00:00Z , a"), (2, 1, "-999.25,x"), (2, 2, None)], "file_id bigint, line_no int, cells string")
    out = drift.unified_rows(curves, lines)
    assert {(r.file_id, r.mnemonic, r.as_double, r.as_text) for r in out.collect()} == {(1, "MD", 5.0, None), (1, "T", None, "2020-01-01T00:00:00Z"), (1, "N", None, "a"), (2, "MD", None, None), (2, "T", None, "x")}
    w = drift.wide(out, [("MD", "double"), ("T", "string")])
    assert {(r.file_id, r.md, r.t) for r in w.collect()} == {(1, 5.0, "2020-01-01T00:00:00Z"), (2, None, "x")}


def cells_by_curve(spark, data, lines):
    out = drift.unified_rows(spark.createDataFrame(data, COLS), spark.createDataFrame(lines, "file_id bigint, line_no int, cells string"))
    return {(r.curve, r.file_id): (r.mnemonic, r.kind, r.as_double) for r in out.collect()}


def test_a_renamed_curve_stays_one_column(spark):
    lines = [(1, 1, "1,2"), (2, 1, "3,4,5"), (3, 1, "6,7")]
    steady = rows("L", 1, 0, [c("k1", "DEPT", k="long"), c("k2", "GR")]) + rows("L", 2, 1, [c("k2", "GR2"), c("k1", "MD"), c("k3", "GR")]) + rows("L", 3, 2, [c("k3", "GR"), c("k1", "DEPTH")])
    assert cells_by_curve(spark, steady, lines) == {
        ("DEPT", 1): ("DEPT", "double", 1.0), ("GR", 1): ("GR", "double", 2.0), ("GR", 2): ("GR2", "double", 3.0), ("DEPT", 2): ("MD", "double", 4.0),
        ("GR#2", 2): ("GR", "double", 5.0), ("GR#2", 3): ("GR", "double", 6.0), ("DEPT", 3): ("DEPTH", "double", 7.0),
    }
    # uids count the places; TG is away in one file, MD is renamed
    loose = rows("P", 1, 0, [c("c1", "MD", "measured depth", k="long"), c("c2", "TG", "total gas")]) + rows("P", 2, 1, [c("c1", "ROP", "rate of penetration"), c("c2", "DEPT", "measured depth"), c("c3", "X", "x")]) + rows("P", 3, 2, [c("c1", "TG", "total gas"), c("c2", "DEPT", "measured depth")])
    assert cells_by_curve(spark, loose, lines) == {
        ("MD", 1): ("MD", "double", 1.0), ("TG", 1): ("TG", "double", 2.0), ("ROP", 2): ("ROP", "double", 3.0), ("MD", 2): ("DEPT", "double", 4.0),
        ("X", 2): ("X", "double", 5.0), ("TG", 3): ("TG", "double", 6.0), ("MD", 3): ("DEPT", "double", 7.0),
    }
    schema = drift.steady_schema(drift.curve_columns(spark.createDataFrame(steady, COLS))).collect()
    assert {(r.curve, tuple(r.mnemonics), r.kind, r.files) for r in schema} == {("DEPT", ("DEPT", "DEPTH", "MD"), "double", 3), ("GR", ("GR", "GR2"), "double", 2), ("GR#2", ("GR",), "double", 2)}
