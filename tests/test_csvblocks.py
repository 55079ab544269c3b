"""Splitting CSV files with line breaks in fields, against a reader that takes each file whole."""

import random

import pytest

from querysieve.sources.csvblocks import ends_quoted, entries, fields_of, read_records
from querysieve.sources.csvlog import import_log, read_log


def whole(spark, path):
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    return sorted(((r.Query or "", r.Label) for r in rows.collect()), key=repr)


def ours(spark, path):
    return sorted(((r.raw_sql, r.label) for r in read_log(spark, path).collect()), key=repr)


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def odd_file(seed, n, long=20):
    draw = random.Random(seed)
    pieces = ["select 1", "it's", '"', '""', ",", "\n", "\r\n", "\n\n", "é😀", "x" * long, " ", '","', '"\n"', "1"]
    out = []
    for _ in range(n):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 8)))
        field = quoted(text) if any(c in text for c in ',"\n\r') or draw.random() < 0.3 else text
        out.append(f"{draw.randint(0, 9)},{field},{draw.choice(['0', '1', 'x', '', quoted('1')])}")
        if draw.random() < 0.05:
            out.append("")
    end = draw.choice(["\n", "\r\n"])  # the other reader takes one kind of line end a file
    return end.join(["No,Query,Label", *out]) + draw.choice(["", end])


@pytest.fixture(params=[256, 4096])
def small_blocks(spark, request):
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_whole_file_reader(spark, tmp_path, small_blocks, seed):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_bytes(odd_file(seed * 10 + k, 120).encode())
    names, records = read_records(spark, str(tmp_path))
    assert names == ["No", "Query", "Label"] and records.rdd.getNumPartitions() > 4
    # The other reader turns \r\n within fields into \n where lines end with \r\n.
    same = lambda rows: sorted(((q.replace("\r\n", "\n"), label) for q, label in rows), key=repr)
    assert same(ours(spark, str(tmp_path))) == same(whole(spark, str(tmp_path)))


def test_a_field_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f'line {k}, "{k}"' for k in range(3000))
    (tmp_path / "a.csv").write_text(f"Query,Label\na,1\n{quoted(long)},0\nb,1\n{quoted(long[:700])},1\n")
    assert ours(spark, str(tmp_path)) == sorted([("a", "1"), (long, "0"), ("b", "1"), (long[:700], "1")], key=repr) == whole(spark, str(tmp_path))


def test_order_and_first_of_equal_rows(spark, tmp_path, small_blocks):
    body = "".join(f"{quoted(f'q{k % 50}' + chr(10))},{k}\n" for k in range(400))
    (tmp_path / "a.csv").write_text("Query,Label\n" + body)
    rows = [r.label for r in read_log(spark, str(tmp_path)).orderBy("ord").collect()]
    assert rows == [str(k) for k in range(400)]
    got = import_log(read_log(spark, str(tmp_path))).collect()
    assert sorted((r.raw_sql, r.label, r.n_dups) for r in got) == sorted((f"q{k}\n", k, 8) for k in range(50))


def test_stray_quotes_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Label,Query\r\n1,admin\" or 1=1\r\n0,\"a\"\"b\"\r\n\r\n1,\n2\n".encode())
    assert ours(spark, str(tmp_path)) == sorted([('admin" or 1=1', "1"), ('a"b', "0"), ("", "1"), ("", "2")], key=repr)
    (tmp_path / "b.csv").write_text("Query,Label\na,1\n")
    with pytest.raises(ValueError, match="different headers"):
        read_log(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no Query"):
        (tmp_path / "c").mkdir()
        (tmp_path / "c/x.csv").write_text("a,b\n1,2\n")
        read_log(spark, str(tmp_path / "c"))


def test_empty_files(spark, tmp_path):
    for name, text in (("a", ""), ("b", "Query,Label\n"), ("c", "Query,Label")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(text)
        assert ours(spark, str(tmp_path / name)) == []


@pytest.mark.parametrize(
    "line, quoted, after",
    [("a,b", False, False), ('a,"b', False, True), ('a,"b"', False, False), ('a,"b""', False, True), ('a"b,c', False, False), ('x', True, True), ('x"', True, False), ('x",y', True, False), ('x","y', True, True), ('""', True, True), ('"""', True, False), ('x"z"w,"', True, True), ('"', False, True)],
)
def test_lines_as_functions(line, quoted, after):
    assert ends_quoted(line, quoted) is after


def test_fields():
    assert fields_of('a,,"",b"c,"d""e"f\r') == ["a", None, "", 'b"c', 'd"ef']
    assert entries([]) == ({}, False)
