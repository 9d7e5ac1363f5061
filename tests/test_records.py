"""Records across line breaks, encodings and headers, against Python's own CSV reader."""

import csv
import io as pyio
import random

import pytest
from pyspark.sql import functions as F

from tableprep.sources import io, records


def plain_open(line, inside, sep=","):
    """Whether quotes are open after a line, letter by letter."""
    state, start, i = inside, not inside, 0
    while i < len(line):
        c = line[i]
        if state:
            if c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    state = False
            start = False
        elif c == '"' and start:
            state, start = True, False
        else:
            start = c == sep
        i += 1
    return int(state)


def test_quotes_after_a_line(spark):
    rnd = random.Random(4)
    lines = ["".join(rnd.choice('",a') for _ in range(rnd.randrange(9))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in lines], "v string")
    out = df.select("v", records.quotes_after(F.col("v"), False).alias("o"), records.quotes_after(F.col("v"), True).alias("i"))
    for r in out.collect():
        assert (r["o"], r["i"]) == (plain_open(r["v"], False), plain_open(r["v"], True)), r


@pytest.mark.parametrize("split", [None, 30])
def test_records_with_line_breaks_over_splits(spark, tmp_path, split):
    rnd = random.Random(5)
    texts = ["plain", "two\nlines", 'a "quoted" word', "comma, here", "", "\n\n\n", 'x"\n"y', "é\nü", "12\" pipe"]
    want = []
    for f in range(3):
        rows = [(f * 1000 + i, "".join(rnd.choice(texts) for _ in range(rnd.randrange(1, 3))), round(i / 4, 2)) for i in range(16)]
        names = ["id", "note", "x"]
        order = [[0, 1, 2], [2, 0, 1], [1, 2, 0]][f]
        out = pyio.StringIO()
        writer = csv.writer(out, lineterminator="\n" if f else "\r\n", quoting=csv.QUOTE_ALL if f == 1 else csv.QUOTE_MINIMAL)
        writer.writerow([names[i] for i in order])
        writer.writerows([[r[i] for i in order] for r in rows])
        (tmp_path / f"part {f}.csv").write_bytes(out.getvalue().encode("latin-1" if f == 2 else "utf-8"))
        want += [(a, b or None, c) for a, b, c in rows]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        good, bad = io.read_csv_with_rejects(spark, str(tmp_path), spark.createDataFrame([], "id long, note string, x double").schema)
        found = sorted((r["id"], r["note"], r["x"]) for r in good.collect())
        assert bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == sorted(want)


def test_rejects_headers_and_open_quotes(spark, tmp_path):
    schema = spark.createDataFrame([], "x int, y string").schema
    (tmp_path / "a.csv").write_text('"y","more","x"\n"b\nc",q,1\nd,q,oops\n\n"x","y",2\n')
    (tmp_path / "b.csv").write_text("7,no header\n8,\"never closed\n9,fine\n")
    (tmp_path / "c.csv").write_text("x\n5\n")
    (tmp_path / "d.csv").write_text("x,y\n")
    good, bad = io.read_csv_with_rejects(spark, str(tmp_path), schema)
    rows = sorted((r["x"], r["y"]) for r in good.filter("y IS NOT NULL").collect())
    assert rows[:2] == [(1, "b\nc"), (2, "x")] and (7, "no header") in rows and (9, "fine") in rows
    assert [r["x"] for r in good.filter("y IS NULL").collect()] == [5]
    assert ("a.csv", "d,q,oops") in {(r["file"], r["record"]) for r in bad.collect()}
    (tmp_path / "e.csv").write_text("x,x\n1,2\n")
    with pytest.raises(ValueError):
        io.read_csv_with_rejects(spark, str(tmp_path), schema)


def test_files_of_no_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n\n")
    good, bad = io.read_csv_with_rejects(spark, str(tmp_path), spark.createDataFrame([], "x int").schema)
    assert good.count() == 0 and bad.count() == 0 and good.columns == ["x"]


def test_encodings_are_chosen_per_file(spark, tmp_path):
    (tmp_path / "a one.csv").write_bytes("id,name\n1,Zoë\n".encode())
    (tmp_path / "b.csv").write_bytes("id,name\n2,Zoë\n".encode("latin-1"))
    found = io.read_csv(spark, str(tmp_path))
    assert sorted((r["id"], r["name"]) for r in found.collect()) == [(1, "Zoë"), (2, "Zoë")]
    assert io.read_csv(spark, str(tmp_path / "b.csv")).first()["name"] == "Zoë"
    assert io.read_csv(spark, str(tmp_path / "a one.csv"), schema="id int, name string").first()["name"] == "Zoë"
