import pytest

from ammolite.sources import sinks, text


def test_grouped_table(spark, tmp_path):
    (tmp_path / "a.dat").write_text("﻿# comment\n[note]\n{Early}\ns1\t1,5\t2\r\ns2\tNA\t4\n{Late}\ns3\t?\tx\n\n", encoding="utf-8")
    rows = text.read_grouped(spark, str(tmp_path / "a.dat"), decimal=",").orderBy("row_id").collect()
    assert [(r.grp, r.label, r["values"]) for r in rows] == [("Early", "s1", [1.5, 2.0]), ("Early", "s2", [None, 4.0]), ("Late", "s3", [None, None])]


def test_landmarks(spark, tmp_path):
    (tmp_path / "a.tps").write_text("LM=2\n1 2\n3.5 4\nID=one\nSCALE=2\nLM=1\n0 1\nID=two\n")
    rows = text.read_landmarks(spark, str(tmp_path / "a.tps")).orderBy("specimen", "lm").collect()
    assert [(r.specimen, r.id, r.lm, r.coords) for r in rows] == [(1, "one", 1, [2.0, 4.0]), (1, "one", 2, [7.0, 8.0]), (2, "two", 1, [0.0, 1.0])]


def test_tables_and_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("site,a,b\nx,1,-\ny,oops,2.5\n")
    assert [tuple(r) for r in text.read_table(spark, str(tmp_path / "t.csv"), label="site").orderBy("site").collect()] == [("x", 1.0, None), ("y", None, 2.5)]
    (tmp_path / "c.txt").write_text("# age d18o\n0 3.2\n  1   3.4\n\n2\n")
    assert [(r.age, r.d) for r in text.read_columns(spark, str(tmp_path / "c.txt"), ["age", "d"]).orderBy("row_id").collect()] == [(0.0, 3.2), (1.0, 3.4), (2.0, None)]


def test_newick(spark):
    trees = spark.createDataFrame([(1, "((A:1,'B (x)':2)[c[d]]ab:0.5,C_d:3);"), (2, "((A,B);"), (3, None)], "id int, t string")
    rows = text.parse_newick(trees, "id", "t").collect()
    named = {r.name: (r.parent_id, r.length) for r in rows if r.tree_id == "1" and r.name}
    assert named == {"ab": (0, 0.5), "A": (1, 1.0), "B (x)": (1, 2.0), "C d": (0, 3.0)}
    assert [r.error for r in rows if r.tree_id == "2"] == ["brackets do not match"]
    with pytest.raises(ValueError):
        text.newick_nodes("(A[open")


def test_lines_out(spark):
    df = spark.createDataFrame([("a,b", 1.5, None), ('q"', 2.0, "x_y")], "n string, v double, s string")
    assert [r.value for r in sinks.delimited(df).collect()] == ['"a,b",1.5,', '"q""",2.0,x_y']
    assert [r.value for r in sinks.latex(df).collect()][1] == r'q" & 2.0 & x\_y \\'
    cells = spark.createDataFrame([("Homo s", 1, "0"), ("Homo s", 2, None), ("Pan", 2, "1"), ("Pan", 1, "1")], "taxon string, pos int, state string")
    assert sorted(r.value.strip() for r in sinks.nexus_matrix(cells).collect()) == ["'Homo s'  0?", "Pan  11"]
