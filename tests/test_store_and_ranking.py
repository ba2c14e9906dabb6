"""Versioned tables, positions of rows and digest trees."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import classes, ranking
from gaugeline.sources import files
from gaugeline.sources.store import ConflictError, Store


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.current() == (0, []) and store.read() is None
    rows = spark.createDataFrame([(1, "a", 1.0), (None, "a", 2.0), (1, "a", 3.0)], "k int, t string, v double")
    assert store.append_missing(rows, ["k", "t"]) == 2 and store.append_missing(rows, ["k", "t"]) == 0
    more = spark.createDataFrame([(None, "a", 9.0), (2, "b", 4.0)], "k int, t string, v double")
    assert store.append_missing(more, ["k", "t"]) == 1 and store.current()[0] == 2
    assert sorted((r.k or 0, r.t) for r in store.read().collect()) == [(0, "a"), (1, "a"), (2, "b")]

    def reject(written):
        raise ValueError("no")

    with pytest.raises(ValueError):
        store.replace(more, reject)
    assert store.read().count() == 3
    store.replace(more)
    assert store.read().count() == 2 and store.vacuum() > 0 and store.read().count() == 2


def test_a_writer_that_comes_late_and_a_manifest_cut_short(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = spark.range(3)
    store.replace(one)
    folder = store.write(one)
    store.replace(spark.range(5))
    with pytest.raises(ConflictError):
        store._commit(1, [folder])
    assert store.read().count() == 5
    (tmp_path / "s/_manifests/000000000003.json").write_text('{"folders": ["da')
    assert store.current()[0] == 2 and store.read().count() == 5
    store.replace(spark.range(7))
    assert store.read().count() == 7


def test_positions(spark):
    chance = random.Random(2)
    rows = [(chance.choice(["hot", "hot", "hot", "a", "b", None]), chance.randint(0, 99), i) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, ts int, id int").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        got = ranking.ranked_rows(df, [F.desc("ts"), "id"]).collect()
        want = sorted(rows, key=lambda r: (-r[1], r[2]))
        assert [r[2] for r in want] == [r.id for r in sorted(got, key=lambda r: r.position)]
        for hot_rows in (1, 300, 10**6):
            found = {r.id: r.sequence for r in ranking.numbered_rows(df, ["k"], ["ts", "id"], hot_rows=hot_rows).collect()}
            for key in ("hot", "a", "b", None):
                ids = [r[2] for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])]
                assert [found[i] for i in ids] == list(range(1, len(ids) + 1))
        assert ranking.ranked_rows(df.limit(0), ["id"]).collect() == []
        assert ranking.numbered_rows(df.limit(0), ["k"], ["id"]).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_hot_key_spreads(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', 'k' || id) AS k", "id")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        assert ranking.hot_keys(df, ["k"], 1000) == [df.filter("k = 'hot'").select(F.xxhash64("k")).first()[0]]
        placed = ranking._sorted_parts(df.filter("k = 'hot'"), ["k", "id"], "probe")
        assert placed.groupBy("__part").count().count() >= 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_more_classes_than_a_task_should_sort(spark):
    df = spark.range(30_000).selectExpr("id", "if(id < 10, 'x', 'c' || (id % 20000)) AS c")
    ranked = classes.class_distribution(df, "c", ["id"]).orderBy("position").collect()
    assert [r["position"] for r in ranked] == list(range(1, len(ranked) + 1)) and ranked[0]["class"] == "x"
    end = classes.class_imbalance(df, "c", ["id"]).first()
    assert (end["majority_class"], end["minority_class"]) == ("x", ranked[-1]["class"])


def tree(content, fan):
    lines = content.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    level = [hashlib.sha256(x).hexdigest() for x in lines]
    while level:
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            break
    return hashlib.sha256(f"{level[0]} {len(content)}".encode()).hexdigest()


def test_digest_trees(spark, tmp_path):
    contents = {
        "a": b"one\r\ntwo\n\nthree", "b": b"one\r\ntwo\n\nthree\n", "d": b"\n", "e": bytes(range(256)) * 40,
        "f": b"".join(b"line %d\n" % i for i in range(900)),
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1m", "500b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in files.tree_digests(spark, str(tmp_path), 4).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == {name: tree(content, 4) for name, content in contents.items()}
