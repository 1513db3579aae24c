"""One file read in many blocks, quoted line breaks across their ends."""

import csv
import random

import pytest

from veilscore.sources.csv import _csv_records, read_csv_na


@pytest.fixture()
def small_blocks(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes",
                                                "spark.sql.files.minPartitionNum")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    for key, value in old.items():
        spark.conf.set(key, value) if value else spark.conf.unset(key)


def _rows(seed, n):
    rnd = random.Random(seed)
    pieces = ['a', 'bb', '\n', '\n\n', '"', '""', ',', ' ', '\r', 'x\r\ny', 'é', 'NA ', '#']
    return [(i, "t" + "".join(rnd.choice(pieces) for _ in range(rnd.choice([0, 2, 5, 40]))) + ".") for i in range(n)]


def _write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["id", "first\nsecond"])
        out.writerows(rows)


@pytest.mark.parametrize("size", [64, 257, 4096])
def test_one_file_in_many_blocks(spark, tmp_path, small_blocks, size):
    rows = _rows(size, 40 if size == 64 else 150)
    _write(tmp_path / "one.csv", rows)
    small_blocks(size)
    got = read_csv_na(spark, str(tmp_path / "one.csv"))
    assert got.columns == ["id", "first\nsecond"]
    assert sorted(tuple(r) for r in got.collect()) == rows
    if size == 64:
        assert spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 8


def test_a_record_longer_than_blocks(spark, tmp_path, small_blocks):
    rows = [(1, "start"), (2, "long \n" * 300 + '"end"'), (3, "after\n"), (4, "plain")]
    _write(tmp_path / "long.csv", rows)
    small_blocks(100)
    got = read_csv_na(spark, str(tmp_path / "long.csv"))
    assert sorted(tuple(r) for r in got.collect()) == rows


def test_many_files_and_line_ends(spark, tmp_path, small_blocks):
    folder = tmp_path / "many"
    folder.mkdir()
    everything = []
    for i in range(5):
        rows = [(100 * i + j, t) for j, t in _rows(i, 20)]
        _write(folder / f"f{i}.csv", rows, "\r\n" if i == 3 else "\n")
        everything += rows
    (folder / "empty.csv").write_text("")
    (folder / "header.csv").write_text('id,"first\nsecond"\n')
    (folder / "gaps.csv").write_text('id,"first\nsecond"\n\n7001,"a"\n\n\n7002,b')
    everything += [(7001, "a"), (7002, "b")]
    small_blocks(128)
    got = read_csv_na(spark, str(folder))
    assert sorted(tuple(r) for r in got.collect()) == sorted(everything)


def test_text_is_not_shuffled(spark, tmp_path, small_blocks):
    _write(tmp_path / "one.csv", _rows(1, 200))
    small_blocks(1 << 20)
    plan = _csv_records(spark, str(tmp_path / "one.csv"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1        # the pieces alone


def test_no_rows(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    got = read_csv_na(spark, str(tmp_path / "h.csv"))
    assert got.columns == ["a", "b"] and got.count() == 0
