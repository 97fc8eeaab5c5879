"""Many files cleaned together give what each file gives alone."""

import os
import random
import re

import pytest

from tabclean.operators.rows import FilterRule
from tabclean.plans.cleaning import clean
from tabclean.plans.request import CleanRequest, ManualOptions
from tabclean.sources.batch import clean_batch, clean_files, output_folder
from tabclean.sources.csv import read_csv, write_csv


def _file(folder, name, rows, header="id,name,when,x,y,flag"):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([header, *rows]) + "\n")
    return path


def _rows(seed, n, gaps=0.2, ids=True):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        cells = [str(i if ids else rnd.randint(0, 3)), rnd.choice(["ann", "bob", "cy", "N/A", " dee "]),
                 rnd.choice(["2024-01-05", "1/6/2024", "2024-01-05 10:00:00", "soon" if seed % 3 == 0 else "2024-02-01"]),
                 str(rnd.randint(0, 50)), f"{rnd.gauss(0, 1):.3f}", rnd.choice(["True", "False"])]
        out.append(",".join("" if rnd.random() < gaps else c for c in cells))
        if rnd.random() < 0.2:
            out.append(out[-1])
    return out


MANUAL = {
    "mean": ManualOptions(fill_numeric_strategy="mean", fill_text_strategy="constant", text_constant="unknown"),
    "all": ManualOptions(target_column="x", drop_missing_rows_threshold=0.5, fill_numeric_strategy="median", fill_text_strategy="mode",
                         convert_datetimes=True, encode_categoricals=True, remove_outliers=True, outlier_zscore_threshold=2.0, scale_numeric=True,
                         filter_rules=[FilterRule("x", "greater_than", "3"), FilterRule("when", "not_equals", "2024-01-05"), FilterRule("", "equals", "")]),
    "none": ManualOptions(drop_columns=["y", "nope"], remove_duplicates=False, fill_numeric_strategy="none", fill_text_strategy="none",
                          convert_datetimes=False, remove_outliers=True),
}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("keyed"))
    made = [_file(folder, f"f{i}.csv", _rows(i, 40)) for i in (1, 3)]
    made.append(_file(folder, "sparse (a).csv", _rows(10, 30, gaps=0.9, ids=False)))
    made.append(_file(folder, "other.csv", ['1,"a\nb"', '2,"c ""d"" , e"', "3,"], header="k,note"))
    made.append(_file(folder, "blank.csv", [",,,,,"] * 3))
    made.append(_file(folder, "header only.csv", []))
    return made


@pytest.mark.parametrize("recipe", ["auto", *MANUAL])
def test_same_as_alone(spark, files, tmp_path, recipe):
    request = CleanRequest() if recipe == "auto" else CleanRequest(mode="manual", manual=MANUAL[recipe])
    files = {"auto": files[1:4], "all": files[:3], "mean": files[1:3], "none": files[3:]}[recipe]
    done = clean_batch(spark, files, request, str(tmp_path / "out"))
    assert list(done) == files
    for path in files:
        alone = clean(read_csv(spark, path), request)
        write_csv(alone.df, want := str(tmp_path / "alone" / os.path.basename(path)))
        reason, steps = done[path]
        assert reason is None and steps == alone.steps, path
        read = [spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p) for p in (want, output_folder(str(tmp_path / "out"), path))]
        assert read[0].columns == read[1].columns, path
        # Sums of another order differ in their last digits.
        rows = [[[round(float(v), 9) + 0.0 if re.fullmatch(r"-?[\d.]+(e-?\d+)?", v or "") else str(v) for v in r] for r in df.collect()] for df in read]
        assert sorted(map(str, rows[0])) == sorted(map(str, rows[1])), path
        alone.release()


def test_bad_files_are_reported_and_the_others_go_on(spark, tmp_path):
    good = _file(tmp_path, "good.csv", ["1,a", "2,b"], header="k,v")
    bad = _file(tmp_path, "bad.csv", ["1,a,extra"], header="k,v")
    twice = _file(tmp_path, "twice.csv", ["1,a"], header="k,k")
    _file(tmp_path, "empty.csv", [], header="")
    (tmp_path / "notes.txt").write_text("x")
    rows = {r["name"]: r for r in clean_files(spark, str(tmp_path), CleanRequest(mode="manual", manual=MANUAL["mean"]), str(tmp_path / "out")).collect()}
    assert rows["good.csv"]["accepted"] and os.path.isdir(rows["good.csv"]["output"].removeprefix("file:"))
    assert "more fields than the header" in rows["bad.csv"]["reason"] and "duplicate column names" in rows["twice.csv"]["reason"]
    assert rows["notes.txt"]["reason"] and not rows["notes.txt"]["accepted"]
    assert good and bad and twice


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    request = CleanRequest(mode="manual", manual=MANUAL["mean"])

    def jobs(n):
        folder = tmp_path / f"in{n}"
        folder.mkdir()
        paths = [_file(folder, f"f{i}.csv", _rows(3 * i + 1, 60)) for i in range(n)]
        sc = spark.sparkContext
        sc.setJobGroup(f"keyed-{n}", "count")
        done = clean_batch(spark, paths, request, str(tmp_path / f"out{n}"))
        got = len(sc.statusTracker().getJobIdsForGroup(f"keyed-{n}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert all(reason is None for reason, _ in done.values())
        return got

    few, many = jobs(2), jobs(16)
    assert many <= few + 5


def test_dead_letters(spark, tmp_path):
    from tabclean.streaming.replay import replay_stream
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i, rows in enumerate((["1,a"], ["1,a,b"], ["2,b"])):
        _file(src, f"f{i}.csv", rows, header="k,v")
    got = replay_stream(spark, str(src), CleanRequest(mode="manual", manual=MANUAL["mean"]), out, checkpoint=str(tmp_path / "ck"), files_per_batch=1)
    dead = spark.read.parquet(f"{out}/dead_letter").collect()
    assert len(dead) == 1 and dead[0]["path"].endswith("f1.csv") and "more fields" in dead[0]["reason"]
    assert len(os.listdir(f"{out}/rows")) - ("_SUCCESS" in os.listdir(f"{out}/rows")) - sum(x.startswith(".") for x in os.listdir(f"{out}/rows")) == 2
    _file(src, "f3.csv", ["3,c"], header="k,v")
    again = replay_stream(spark, str(src), CleanRequest(mode="manual", manual=MANUAL["mean"]), out, checkpoint=got["checkpoint"])
    assert again["batches"] >= 1 and spark.read.parquet(f"{out}/dead_letter").count() == 1


def test_replay_takes_many_files_in_one_batch(spark, tmp_path):
    from tabclean.streaming.replay import replay_stream
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i in range(20):
        _file(src, f"f{i}.csv", [f"{k},v{i}" for k in range(i + 1)], header="k,v")
    request = CleanRequest(mode="manual", manual=ManualOptions(fill_numeric_strategy="mean", fill_text_strategy="none", convert_datetimes=False))
    replay_stream(spark, str(src), request, out, checkpoint=str(tmp_path / "ck"))
    folders = [f for f in os.listdir(f"{out}/rows") if f.startswith("source=")]
    assert len(folders) == 20
    rows = spark.read.option("header", True).csv(f"{out}/rows").groupBy("v").count().collect()
    assert sorted((r["v"], r["count"]) for r in rows) == sorted((f"v{i}", i + 1) for i in range(20))
    # one batch, and a small file's rows are written by one task
    assert len([f for f in os.listdir(tmp_path / "ck" / "commits") if f.isdigit()]) == 1
    assert all(len([p for p in os.listdir(f"{out}/rows/{f}") if p.endswith(".csv")]) == 1 for f in folders)


def test_large_files_are_read_by_records(spark, tmp_path):
    rnd = random.Random(2)
    for kind, text in (("records", lambda i: '"v\n""{}"" , x\n"'.format(i)), ("split", lambda i: f'"a ""b"" {i}"'), ("whole", lambda i: f'5" pipe {i}' if i % 50 == 3 else f'"a\n{i}"')):
        path = _file(tmp_path, f"{kind}.csv", [f'{i},{text(i)},{"z" * rnd.randint(0, 40)}' for i in range(3000)], header="k,v,w")
        want = read_csv(spark, path, multi_line=True).collect()
        size = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
            from tabclean.sources import csv
            mode = csv.scan_files(spark, path).first()["mode"]
            assert mode == {"records": "records", "split": "split", "whole": "records"}[kind]
            got = read_csv(spark, path)
            assert sorted(got.collect()) == sorted(want), kind
            if kind != "whole":
                assert csv.read_text_columns(spark, [path], "utf-8", mode).rdd.getNumPartitions() > 5
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
