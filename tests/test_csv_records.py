import csv
import io
import random

import pytest

from fieldloom.plans.encoding import repair_csv
from fieldloom.session import configure
from fieldloom.sources import csv_records as V
from fieldloom.sources import readers as R


def table(n, seed, end="\n"):
    rng = random.Random(seed)
    values = ["plain", "", "two\nlines", "a,b", 'say "hi"', '"', '""', '"\n"', ',"', "x\r\ny", "\n\n", "end\n", "é ü", '{"k": "v,\n"}', "  spaced "]
    rows = [["id", "a", "b c"]]
    rows += [[str(i), rng.choice(values), "".join(rng.choices(values, k=rng.choice([1, 1, 2, 9])))] for i in range(n)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def plain(text):
    head, *rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return sorted(tuple(r) for r in rows)


@pytest.fixture
def blocks(spark):
    """Sets the size of the blocks files are read in."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    configure(spark)
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_a_file_cut_into_blocks(spark, blocks, tmp_path, end):
    text = table(900, 1, end)
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    blocks(len(text.encode()) // 20)
    assert spark.read.text(str(path)).rdd.getNumPartitions() >= 20
    got = R.read_csv_groups(spark, str(path))
    assert [df.columns for df in got] == [["id", "a", "b c", "source_file"]]
    assert sorted((r.id, r.a or "", r["b c"] or "") for r in got[0].collect()) == plain(text)
    # Records begin in many blocks, so many tasks have work.
    assert V.csv_records(spark, [str(path)]).select("block").distinct().count() >= 15


def test_a_record_over_several_blocks(spark, blocks, tmp_path):
    long = "\n".join(f'line {i}, "{i}"' for i in range(400))
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([["id", "t"], ["1", "x"], ["2", long], ["3", "y"], ["4", long], ["5", ""]])
    path = tmp_path / "a.csv"
    path.write_bytes(out.getvalue().encode())
    blocks(700)
    got = R.read_csv_groups(spark, str(path))[0]
    assert sorted((r.id, r.t or "") for r in got.collect()) == plain(out.getvalue())


def test_stray_quotes_do_not_open_a_value(spark, blocks, tmp_path):
    text = 'id,size,note\n1,5" pipe,"a\nb"\n2,7" pipe,c\n3,"x ""y"" z",d\n4,,"e"\n5,9" and 3",\n'
    (tmp_path / "a.csv").write_text(text)
    blocks(9)
    got = R.read_csv_groups(spark, str(tmp_path / "a.csv"))[0]
    assert sorted((r.id, r["size"] or "", r.note or "") for r in got.collect()) == plain(text)


def test_headers_and_many_files(spark, blocks, tmp_path):
    files = {
        "a.csv": 'id,"two\nlines"\n1,x\n', "b.csv": 'id,"two\nother"\n2,"y\nz"\n', "c.csv": 'id,,ID\n3,"q\nr",s\n\n\n4,t\n',
        "d.csv": "", "e.csv": "id,n\n", "f.csv": '﻿id,n\n5,"one\ntwo"',
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "g.csv").write_bytes('id,n\n6,"علي\nسارا"\n'.encode("cp1256"))
    blocks(16)
    rows = {r.source_file: r.asDict() for df in R.read_csv_groups(spark, str(tmp_path)) for r in df.orderBy(df.columns[0]).collect()}
    assert rows["a.csv"]["two\nlines"] == "x" and rows["b.csv"]["two\nother"] == "y\nz"
    assert rows["c.csv"] == {"id0": "4", "_c1": "t", "ID2": None, "source_file": "c.csv"}
    assert rows["f.csv"]["n"] == "one\ntwo" and rows["g.csv"]["n"] == "علي\nسارا"
    assert set(rows) == set("abcfg"[i] + ".csv" for i in range(5))


def test_repair_writes_split_files_again(spark, blocks, tmp_path):
    text = table(300, 3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(text.encode())
    blocks(500)
    rows = repair_csv(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert sorted((r.id, r.a or "", r["b c"] or "") for r in rows) == plain(text)
