import pytest
from pyspark.sql import functions as F

from denspark.__main__ import main
from denspark.sources.text import read_header, read_points, write_labels


@pytest.mark.parametrize("text", ["1,2\n3,4\n", "x,y\n1,2\n3,4\n", "1;2\n3;4\n", "1, 2\n3, 4\n", "1\t2\t\r\n3 4,\r\n", "a b\n1 2\n3 4"])
def test_read(spark, tmp_path, text):
    path = tmp_path / "points.txt"
    path.write_text(text)
    assert read_header(spark, str(path)) == 2
    assert [tuple(r) for r in sorted(read_points(spark, str(path)).collect())] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]


def test_malformed(spark, tmp_path):
    path = tmp_path / "points.txt"
    path.write_text("1,2\n3,x\n5,6\n")
    with pytest.raises(ValueError):
        read_points(spark, str(path))
    assert [tuple(r) for r in sorted(read_points(spark, str(path), mode="PERMISSIVE").collect())] == [(0, 1.0, 2.0), (1, 5.0, 6.0)]


def test_write_and_command_line(spark, tmp_path):
    (tmp_path / "in.txt").write_text("x y\n0 0\n0 1\n9 9\n")
    assert main(["-o", str(tmp_path / "out"), "--eps", "1.5", "--min-samples", "2", str(tmp_path / "in.txt")], spark) == 0
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().split() if x != "cluster-id"]
    assert lines == ["0", "0", "-1"]
    write_labels(spark.createDataFrame([(2, 5), (1, 4)], "id long, label int"), str(tmp_path / "more"))


def test_integers_and_csv_words(spark, tmp_path):
    from denspark.sources.text import csv_words, read_integers, write_integers

    values = [(i, (i * 37) % 101 - 50) for i in range(300)]
    write_integers(spark.createDataFrame(values, "i long, v long"), f"file://{tmp_path}/n", "v", "i")
    assert sorted(map(tuple, read_integers(spark, f"file://{tmp_path}/n").collect())) == values
    (tmp_path / "bad.txt").write_text("1\n2\n")
    with pytest.raises(ValueError):
        read_integers(spark, f"file://{tmp_path}/bad.txt")
    line = spark.createDataFrame([("a b,,c\td",)], "x string").select(csv_words(F.col("x")).alias("w")).first()
    assert line.w == ["a b", "c", "d"]
