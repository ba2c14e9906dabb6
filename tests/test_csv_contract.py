import gzip
import hashlib
import math
import random
import re

import pytest

from gaugeline.sources import csv_contract as C
from gaugeline.sources import files, synthetic


@pytest.fixture
def load(spark, tmp_path):
    def run(content, name="in.csv"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return C.import_csv(spark, str(path), str(tmp_path / "out"), view=None)

    return run


def test_null_tokens_and_late_text(load):
    ds = load('id,value,empty,label\n001,1,,NA\n002,2,"",ok\n003,late,NULL,null\n')
    assert ds.dtypes == {"id": "object", "value": "object", "empty": "float64", "label": "object"}
    assert ds.null_counts == {"id": 0, "value": 0, "empty": 3, "label": 2}
    assert any("leading zero" in w and "id" in w for w in ds.warnings)
    assert [r["id"] for r in ds.df.orderBy("id").collect()] == ["001", "002", "003"]
    assert ds.preview().collect()[1]["empty"] is None
    assert ds.run_check("missing_values_check").data["affected_columns"][0]["column"] == "empty"


@pytest.mark.parametrize(
    "content, reason",
    [
        ("a,b\n1\n", "do not have 2 fields"),
        ("a,b\n1,2,3\n", "do not have 2 fields"),
        ('a,b\n"1,2\n', "unexpected end of data"),
        ('a,b\n"1"x,2\n', "expected after"),
        ("a,b\n", "header but no rows"),
        ("a,b\n1,\0\n", "NUL"),
        ("a,,c\n1,2,3\n", "no name"),
        ("Unnamed: 0,b\n1,2\n", "no name"),
        ("Temp,temP\n1,2\n", "letter case only"),
        ("", "no record"),
        ("h" * 257 + ",b\n1,2\n", "256"),
        (",".join(f"c{i}" for i in range(1001)) + "\n", "1,000"),
        (b"a,b\n\x81,2\n", "neither"),
    ],
)
def test_rejections(load, content, reason):
    with pytest.raises(C.ContractError, match=reason):
        load(content)


def test_wrong_suffix(load):
    with pytest.raises(C.ContractError, match="csv"):
        load("a\n1\n", "in.txt")


def test_windows_encoding_multiline_and_repeated_header(load):
    ds = load('part,part,part.1,count\n"Größe\nzwei",2,3,4\n\nx,y,z,\n'.encode("cp1252"))
    assert ds.columns == ["part", "part.2", "part.1", "count"]
    assert ds.encoding == "cp1252" and ds.dtypes["count"] == "float64" and ds.null_counts["count"] == 1
    assert {r["part"] for r in ds.df.collect()} == {"Größe\nzwei", "x"}


def test_lexemes(load):
    ds = load("a,b,c,d,e\n NaN ,inf,1_000,١٢, 5 \nword,-inf,2000,٣,6\n")
    assert ds.dtypes == {"a": "object", "b": "float64", "c": "object", "d": "object", "e": "int64"}
    assert {r["b"] for r in ds.df.collect()} == {math.inf, -math.inf}
    assert {r["e"] for r in ds.df.collect()} == {5, 6}


def test_integer_limits_and_marks(load):
    ds = load('﻿a,b,c\n"x, ""y""",9223372036854775807,1d\nz,-9223372036854775808,1e5\n')
    assert ds.columns[0] == "a" and ds.dtypes == {"a": "object", "b": "int64", "c": "object"}
    assert load("b,c\n9223372036854775808,.5\n1,5.\n").dtypes == {"b": "object", "c": "float64"}


def test_line_breaks_and_blank_lines(load):
    ds = load("a,b\r\n1,2\r\n\r\n3,4\r\n")
    assert ds.row_count == 2 and ds.dtypes == {"a": "int64", "b": "int64"}


def test_fingerprint_is_content_hash(load):
    import hashlib

    content = "a,b\n1,2\n"
    assert load(content).fingerprint == hashlib.sha256(content.encode()).hexdigest()


def test_quarantine_and_quote_errors(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,2\n3\n"x,y",5,6\n')
    bad = C.quarantined(C.open_csv(spark, str(tmp_path / "q.csv"))).collect()
    assert {r["record"] for r in bad} == {"3", '"x,y",5,6'}
    (tmp_path / "r.csv").write_text('a,b\n"1\n2",3\n4\n')
    assert C.quarantined(C.open_csv(spark, str(tmp_path / "r.csv"))).count() == 1
    (tmp_path / "s.csv").write_text('a,b\n"1,2\n')
    assert C.quote_errors(spark, str(tmp_path / "s.csv")).first()["record"] == 2


def test_several_files_must_share_a_header(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "d" / "2.csv").write_text('a,b\n3,"x\ny"\n')
    assert C.import_csv(spark, str(tmp_path / "d"), str(tmp_path / "o"), view=None).row_count == 2
    (tmp_path / "d" / "3.csv").write_text("b,a\n1,2\n")
    with pytest.raises(C.ContractError, match="same header"):
        C.open_csv(spark, str(tmp_path / "d"))


def test_permissive_loader(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("a,a,f,s\n001,2,True,x\n3,4,False\n")
    ds = C.load_permissive(spark, str(path))
    assert ds.columns == ["a", "a.1", "f", "s"] and ds.dtypes == {"a": "int64", "a.1": "int64", "f": "bool", "s": "object"}
    assert any("end in a number" in w for w in ds.warnings)
    path.write_text("a,b\n1,2,3\n")
    with pytest.raises(C.ContractError, match="longer than the header"):
        C.load_permissive(spark, str(path))
    path.write_text('a,b\n1,2\n"3,4\n5,6\n7,8\n')
    with pytest.raises(C.ContractError, match="unreadable"):
        C.load_permissive(spark, str(path))
    path.write_text('a,b\n1,2\n"3,\n4",5\n6\n"7,8"\n')
    ds = C.load_permissive(spark, str(path))
    assert ds.row_count == 4 and ds.null_counts == {"a": 0, "b": 2}
    path.write_text("a,b\n" + "1,2\n" * 300_000)
    with pytest.raises(C.ContractError, match="larger than 1 MB"):
        C.load_permissive(spark, str(path), max_mb=1)


def test_preview_is_of_the_first_file_and_a_failed_import_keeps_the_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("k,v\n" + "".join(f"a{i},{i}\n" for i in range(3)))
    (folder / "b.csv").write_text("k,v\n" + "".join(f"b{i},{i}\n" for i in range(20_000)))
    ds = C.import_csv(spark, str(folder), str(tmp_path / "t"), view=None)
    assert [r["k"] for r in ds.preview().collect()] == ["a0", "a1", "a2"] and ds.df.count() == 20_003
    (folder / "c.csv").write_text("k,v\n1,2,3\n")
    with pytest.raises(C.ContractError):
        C.import_csv(spark, str(folder), str(tmp_path / "t"), view=None)
    assert C.read_table(spark, str(tmp_path / "t")).count() == 20_003


@pytest.mark.parametrize("profile", ["tall_numeric", "quoted_unicode", "null_heavy"])
def test_profile_round_trip(spark, tmp_path, profile):
    df = synthetic.synthetic_range(spark, 301, profile)
    synthetic.write_csv(df, str(tmp_path / "csv"))
    ds = C.import_csv(spark, str(tmp_path / "csv"), str(tmp_path / "table"), view=None)
    assert ds.row_count == 301
    assert ds.df.exceptAll(df).isEmpty() and df.exceptAll(ds.df).isEmpty()


def test_digest_modes(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a\r\n1\r\n")
    (tmp_path / "y.csv").write_bytes(b"a\n1\n")
    plain = {r["sha256"] for r in files.file_digests(spark, str(tmp_path)).collect()}
    same = {r["sha256"] for r in files.file_digests(spark, str(tmp_path), line_feeds=True).collect()}
    assert len(plain) == 2 and len(same) == 1


def test_work_folders_can_be_dropped(spark):
    df = files.materialized(spark.range(10), "probe")
    folder = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 10 and files.drop_work(spark) >= 1 and files.drop_work(spark) == 0
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(folder).count()


def test_table_digest_deals_parts_by_the_size_of_the_scan(spark, tmp_path):
    from gaugeline.queries import registry, source_queries

    rows = spark.range(400).selectExpr("id AS l_orderkey", "id % 37 AS l_partkey", "cast(id AS double) AS l_tax")
    rows.repartition(8).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a part for each file
    try:
        found = source_queries.table_digest(registry.Tables(spark, str(tmp_path)))
        assert "hashpartitioning(l_partkey#" in (plan := found._jdf.queryExecution().executedPlan().toString())
        assert set(re.findall(r"hashpartitioning\(l_partkey#\w+, (\d+)\)", plan)) == {"40"}
        assert found.collect() == [(400, True, True)]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_above_a_step_are_digested_in_steps(spark, tmp_path, monkeypatch):
    rng, bom = random.Random(5), b"\xef\xbb\xbf"
    made = {
        "binary.parquet": rng.randbytes(50_000), "no%20 feed.csv": b"a,b\r\n" * 3_000 + b"x\r", "mark.csv": bom + b"a\n" * 9_000,
        "mark-no-feed.csv": bom + b"\n\n" + b"1\r\r\n" * 9_000 + b"x", "long.bin": b"\0" * 30_000 + b"\n" + b"\n" * 9_000,
        "one-line.bin": b"\0" * 20_000, "sub/binary.parquet": rng.randbytes(4_097), "small": b"\r\n", "full": b"\n" * 4_096,
        "packed.gz": gzip.compress(rng.randbytes(3_000), mtime=0),
    }
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(files, "STEP_BYTES", 4_096, raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 4_096)  # no value holds more of a file
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        for feeds in (False, True):
            found = files.file_digests(spark, str(tmp_path), line_feeds=feeds)
            assert found.columns == ["path", "length", "sha256"]
            rows = {r["path"].split(f"{tmp_path.name}/")[1]: (r["length"], r["sha256"]) for r in found.collect()}
            want = {k: d.replace(b"\r\n", b"\n") if feeds else d for k, d in made.items()}
            assert rows == {k: (len(made[k]), hashlib.sha256(d).hexdigest()) for k, d in want.items()}
    finally:
        for name in ("sources.binaryFile.maxLength", "files.maxPartitionBytes", "files.openCostInBytes"):
            spark.conf.unset(f"spark.sql.{name}")


@pytest.mark.parametrize("blocks", ["in the library", "in Python"])
def test_a_stored_digest_goes_on(monkeypatch, blocks):
    from gaugeline.functions import sha256

    if blocks == "in Python":
        monkeypatch.setattr(sha256, "_blocks", lambda: sha256.blocks_in_python)
    rng = random.Random(6)
    for n in (0, 1, 55, 56, 63, 64, 65, 119, 120, 1_000):
        data, state, at = rng.randbytes(n), sha256.START, 0
        while at < n:
            state, at = sha256.fed(state, data[at : at + (k := rng.randint(1, 130))]), at + k
        assert sha256.hex_digest(state) == hashlib.sha256(data).hexdigest()


def test_a_scan_of_other_bytes_than_listed_gives_no_digest(spark, tmp_path, monkeypatch):
    (tmp_path / "x.gz").write_bytes(gzip.compress(random.Random(7).randbytes(9_000), mtime=0))
    monkeypatch.setattr(files, "STEP_BYTES", 4_096)
    whole = hashlib.sha256((tmp_path / "x.gz").read_bytes()).hexdigest()
    assert [r["sha256"] for r in files.file_digests(spark, str(tmp_path)).collect()] == [whole]
    monkeypatch.setattr(files, "PACKED_NAME", r"\.none$")
    with pytest.raises(Exception, match="Not the bytes that were listed"):
        files.file_digests(spark, str(tmp_path)).collect()
