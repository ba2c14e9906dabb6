"""Records across blocks of any size against the standard library's reader."""

import csv
import io
import random

import pytest

from gaugeline.sources import csv_contract as C
from gaugeline.sources import csv_records


@pytest.fixture
def blocks(spark):
    """Sets the bytes of a scan's block."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def use(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield use
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def read(spark, path, **kw):
    files = [r.path for r in spark.read.format("binaryFile").load(str(path)).select("path").collect()]
    windows = files if kw.pop("windows", False) else []
    rows = csv_records.parse_records(spark, files, windows, **kw).orderBy("file", "record").collect()
    return [(r.record, r.fields, r.error) for r in rows]


def table(seed, rows=120):
    chance = random.Random(seed)
    cells = ["", "plain", "a,b", 'say ""x""', "two\nlines", "cr\rlf\r\nend", '""', "é😀", "x" * 90, "\n\n", ",", "\n,\n"]
    lines = []
    for _ in range(rows):
        parts = []
        for _ in range(chance.randint(1, 4)):
            cell = chance.choice(cells)
            quoted = any(c in cell for c in ',"\n\r') or chance.random() < 0.3
            parts.append(f'"{cell}"' if quoted else cell)
        if chance.random() < 0.1:
            parts.append('5" pipe')
        lines.append(",".join(parts) + chance.choice(["\n", "\r\n", "\n", "\r", "\n\n"]))
    return "head,two" + "\n" + "".join(lines)


@pytest.mark.parametrize("size", [40, 700, 1 << 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_records_of_small_blocks(spark, tmp_path, blocks, size, seed):
    content = table(seed)
    (tmp_path / "a.csv").write_bytes(content.encode())
    want = [r for r in csv.reader(io.StringIO(content, newline=""), strict=True) if r]
    blocks(size)
    assert read(spark, tmp_path) == [(i + 1, r, None) for i, r in enumerate(want)]


def test_reading_goes_on_after_a_bad_record(spark, tmp_path, blocks):
    blocks(16)
    (tmp_path / "a.csv").write_text('a,b\n1,2\n"3"x,4\n\n5,6\n"7\n8",9,10\n11\n"12,13\n14,15\n')
    assert read(spark, tmp_path) == [
        (1, ["a", "b"], None), (2, ["1", "2"], None), (3, None, "a comma was expected after a closing quote"),
        (4, ["5", "6"], None), (5, ["7\n8", "9", "10"], None), (6, ["11"], None),
        (7, None, "unexpected end of data inside quotes"),
    ]
    bad = C.quarantined_records(spark, str(tmp_path / "a.csv")).orderBy("record").collect()
    assert [(r.record, r.found, r.expected) for r in bad] == [(3, None, 2), (5, 3, 2), (6, 1, 2), (7, None, 2)]
    assert bad[1].raw == '"7\n8",9,10' and "header" in bad[2].error


def test_windows_text_and_mark(spark, tmp_path, blocks):
    blocks(8)
    text = "€,Größe\n\"“a”\n–\",Šž\n"
    (tmp_path / "w.csv").write_bytes(text.encode("cp1252"))
    assert read(spark, tmp_path, windows=True) == [(1, ["€", "Größe"], None), (2, ["“a”\n–", "Šž"], None)]
    (tmp_path / "w.csv").write_bytes('﻿"a,\nb",c\n1,2'.encode())
    assert read(spark, tmp_path) == [(1, ["a,\nb", "c"], None), (2, ["1", "2"], None)]


def test_a_quote_that_never_closes_is_not_gathered(spark, tmp_path, blocks):
    blocks(1000)
    (tmp_path / "a.csv").write_text('a,b\n1,2\n"open,' + "line of text\n" * 2000)
    got = read(spark, tmp_path, most=5000)
    assert [(n, f) for n, f, _ in got] == [(1, ["a", "b"]), (2, ["1", "2"]), (3, None)]
    assert "characters" in got[2][2]


def test_one_record_over_many_blocks_and_empty_files(spark, tmp_path, blocks):
    blocks(64)
    cell = "word, " * 400 + "\n" * 30
    (tmp_path / "a.csv").write_text(f'a,b\n"{cell}",2\n3,4\n')
    (tmp_path / "b.csv").write_text("\n\n")
    assert read(spark, tmp_path) == [(1, ["a", "b"], None), (2, [cell, "2"], None), (3, ["3", "4"], None)]


def test_a_file_is_read_by_many_tasks(spark, tmp_path, blocks):
    blocks(4096)
    (tmp_path / "a.csv").write_text("a,b\n" + '"x\ny",1\n' * 20_000)
    ds = C.import_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "t"), view=None)
    assert ds.row_count == 20_000 and ds.df.where("a = 'x\\ny'").count() == 20_000
    files = [str(tmp_path / "a.csv")]
    assert csv_records._segments(spark, files, []).select("block").distinct().count() > 30
