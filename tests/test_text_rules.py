import json
import math
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gaugeline import fixed_values as V
from gaugeline.functions import render, sanitize, text
from gaugeline.plans import publication


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def outputs(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_number_literals_match_brute_force(spark, documents):
    samples = [
        "ratio 1.5:1, 1,234.50 and .77", "a1 1a 1.2.3 v2.0", "-3 +4e5 6E-7 x-8", "12,34 1,2345 0.10",
        "(5) 6. 7", "٣ 8", "9%", "1,000,000", "3.14e", "", "1..2", "5,000.", "é11 ñ2 3é", *documents,
    ]
    df = column(spark, samples)
    assert outputs(df, text.number_texts(F.col("v"))) == [
        [m.group() for m in re.finditer(V.NUMBER_PATTERN, s)] for s in samples
    ]
    values = [
        "1.50", "1.5", "1,000", "1e3", "+2", "-0.250", ".25", "1e-30", "0", "-0.0", "0e9", "1,000.50", "1000.5",
        "100000000000000000000001", "100000000000000000000002", "0.1234567890123456789012345", "12e400", "007", "5."
    ]
    keys = outputs(column(spark, values), text.number_key(F.col("v")))
    assert [Decimal(k) for k in keys] == [Decimal(v.replace(",", "")) for v in values]
    exact = [Decimal(v.replace(",", "")) for v in values]
    assert all((a == b) == (x == y) for a, x in zip(keys, exact) for b, y in zip(keys, exact))


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [r["text"] for r in rows]


def test_json_values_without_keys_and_fingerprint(spark):
    doc = {"dataset_hash": "99", "rows12": 5, "nested": {"k7": [1.5, True, None, 'say "8": 9']}, "s": "line\n10", "u": "é11 12"}
    df = column(spark, [json.dumps(doc, ensure_ascii=False)])
    got = {Decimal(k) for k in outputs(df, text.json_number_keys(F.col("v")))[0]}
    assert got == {Decimal(x) for x in ("5", "1.5", "8", "9", "10", "12")}


@pytest.mark.parametrize(
    "sentence, bold",
    [
        ("The data is completely clean.", True),
        ("It is not good. The data is completely clean.", True),
        ("This cannot be described as fully balanced.", False),
        ("It is not ideal, but entirely valid", True),
        ("There are no data-quality issues.", True),
        ("There is no guarantee that there is no leakage", False),
        ("Results do not say 1.5, so 100% safe", False),
        ("x " * 60 + "not " + "y " * 49 + "fully clean", True),
        ("not " + "y " * 40 + "fully clean", False),
        ("We found 3 issues", False),
        ("It doesn't look perfectly safe; 100.0 % valid", True),
    ],
)
def test_assurance(spark, sentence, bold):
    assert outputs(column(spark, [sentence]), text.unsupported_assurance(F.col("v"))) == [bold]


def test_cleaning(spark):
    raw = ["  a\u0000b\t\n c\u200bd  ", "x" * 300, "x" * 301, "\u2003y\u00a0"]
    df = column(spark, raw)
    assert outputs(df, text.cleaned(F.col("v"))) == ["a b c d", "x" * 300, "x" * 301, "y"]
    assert outputs(df, text.reason_accepted(F.col("v"))) == [True, True, False, True]
    assert text.clean_reason(raw[0]) == "a b c d"
    with pytest.raises(ValueError):
        text.clean_reason(raw[2])
    with pytest.raises(ValueError):
        text.clean_reason(5)


def test_redaction(spark):
    raw = "k gsk_abcdefgh1 Bearer a.b-c /srv/repo/x C:\\Users\\me\\f.txt\nnext org_9Z end topsecret"
    shown = outputs(column(spark, [raw]), text.redacted(F.col("v"), ("topsecret",), "/srv/repo"))[0]
    assert shown == (
        "k [redacted credential] Bearer [redacted] [repository]/x [local path]\nnext "
        "[provider organization] end [redacted credential]"
    )


def test_rendered_numbers(spark):
    values = [0.0, 1.0, 20.0, 6.67, 0.0001, 12345678.5, -13.5, 100.0, 1e-3]
    df = column(spark, values, "double")
    assert outputs(df, render.short_float(F.col("v"))) == [repr(v) for v in values]
    general = [44.5, -26.0, 0.0, 12.0, 1234.5, 12345.0, 0.00012345, 0.000012345, -1e10, 9999.6, 1e-300, 5.0]
    df = column(spark, general, "double")
    expected = [f"{v:.4g}" for v in general]
    got = outputs(df, render.general4(F.col("v")))
    # decimal ties may round the other way in the last of four digits
    assert [g for g, e in zip(got, expected) if g != e and abs(float(g) / float(e) - 1) > 2e-3] == []
    assert got[:4] == ["44.5", "-26", "0", "12"]
    labels = ["plain", "it's", 'say "x"', 'both \' "', "tab\t"]
    assert outputs(column(spark, labels), render.quoted(F.col("v"))) == [repr(x) for x in labels]


def test_nonfinite_anywhere(spark):
    df = spark.createDataFrame(
        [(1, math.inf, [1.0, math.nan], {"k": -math.inf}, (2.0, [math.nan]), "s")],
        "id int, a double, b array<double>, m map<string,double>, s struct<x:double,y:array<double>>, t string",
    )
    row = sanitize.nonfinite_to_null(df, "replaced").first()
    assert row["a"] is None and row["b"] == [1.0, None] and row["m"] == {"k": None}
    assert row["s"]["x"] == 2.0 and row["s"]["y"] == [None] and row["replaced"] == 4


def test_known_secrets_by_rare_grams(spark):
    texts = [f"noise value{i % 7:04d}x tail" * (i % 3) for i in range(60)]
    texts += ["naïve größe-ß€", "aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaa", "k", "", "x" * 3000 + "needle-in-it" + "y" * 3000, None, "needle-in-i"]
    files = spark.createDataFrame([(i if i != 62 else None, t) for i, t in enumerate(texts)], "id int, t string")
    known = [(f"n{i}", f"value{i:04d}") for i in range(9)] + [("dup", "value0001"), ("dup", "value0001"), ("long", "needle-in-it")]
    known += [("hot", "aaaaaaaaaaaa"), ("short", "k"), ("mid", "größe"), ("euro", "€"), ("none", None), ("empty", ""), ("gone", "absent value")]
    secrets = spark.createDataFrame(known, "n string, v string")
    expected = sorted(
        (i, n) for i, t in enumerate(texts) if t is not None for n, v in set(known) if v and v in t
    )
    for rows in (500_000, 0):
        got = publication.known_secret_hits(files, "id", "t", secrets, "n", "v", rows).collect()
        assert sorted((62 if r["id"] is None else r["id"], r["n"]) for r in got) == expected
    assert publication.known_secret_hits(files, "id", "t", secrets.where("false"), "n", "v").collect() == []
    assert publication.known_secret_hits(files.where("false"), "id", "t", secrets, "n", "v").collect() == []


def test_usable_secrets(spark):
    named = spark.createDataFrame([("API_KEY", "123456789"), ("token", "short"), ("HOST", "123456789")], "name string, value string")
    assert [r["name"] for r in publication.usable_secrets(named).collect()] == ["API_KEY"]


def test_file_problems(spark):
    files = spark.createDataFrame(
        [("src/a.md", "ok"), (".env", "x"), ("a/tmp/b", "x"), ("c.md", "sk-" + "a" * 30)], "path string, text string"
    )
    got = {(r["path"], r["problem"].split()[0]) for r in publication.file_problems(files).collect()}
    assert got == {(".env", "Local-only"), ("a/tmp/b", "Local-only"), ("c.md", "Credential-shaped")}
