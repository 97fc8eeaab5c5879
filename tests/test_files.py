"""CSV sources: encodings, quoting, manifest, de-duplicated sources, writer, replay (FIXTURES §4)."""

import os
import shutil

import pytest

from tabclean.plans.request import CleanRequest
from tabclean.sources.batch import clean_files
from tabclean.sources.csv import dedupe_sources, detect_encodings, read_csv, source_manifest, write_csv
from tabclean.streaming.replay import replay_stream


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture()
def files(tmp_dir):
    text = "a,b\n1,café €\n2,x\n"
    _write(f"{tmp_dir}/utf8.csv", text.encode("utf-8"))
    _write(f"{tmp_dir}/utf8_bom.csv", text.encode("utf-8-sig"))
    _write(f"{tmp_dir}/cp1252.csv", text.encode("cp1252"))
    _write(f"{tmp_dir}/latin1.csv", "a,b\n1,café\n2,\x81x\n".encode("latin1"))
    _write(f"{tmp_dir}/quoted.csv", b'name, name ,\nsay ""hi"",2,3\n"line one\nline two",5,6\n\n7,NA,9\n')
    _write(f"{tmp_dir}/empty.csv", b"")
    _write(f"{tmp_dir}/note.txt", b"hello")
    shutil.copy2(f"{tmp_dir}/utf8.csv", f"{tmp_dir}/copy/utf8.csv") if os.makedirs(f"{tmp_dir}/copy") is None else None
    return tmp_dir


def test_detect_encodings(spark, files):
    paths = [f"{files}/{n}.csv" for n in ("utf8", "utf8_bom", "cp1252", "latin1")]
    got = {os.path.basename(r["path"]): r["encoding"] for r in detect_encodings(spark, paths).collect()}
    assert got == {"utf8.csv": "utf-8", "utf8_bom.csv": "utf-8", "cp1252.csv": "cp1252", "latin1.csv": "latin1"}


@pytest.mark.parametrize("name", ["utf8", "utf8_bom", "cp1252"])
def test_read_each_encoding(spark, files, name):
    df = read_csv(spark, f"{files}/{name}.csv")
    assert df.columns == ["a", "b"]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "café €"), (2, "x")]


def test_read_latin1_keeps_undefined_byte(spark, files):
    rows = sorted(tuple(r) for r in read_csv(spark, f"{files}/latin1.csv").collect())
    assert rows == [(1, "café"), (2, "\x81x")]


def test_quoting_and_repeated_headers(spark, files):
    with pytest.raises(ValueError):
        read_csv(spark, f"{files}/quoted.csv")


def test_quoting_values(spark, tmp_dir):
    _write(f"{tmp_dir}/q.csv", b'a,b\n"say ""hi""",2\n"line one\nline two",5\n\n7,NA\n')
    rows = sorted((tuple(r) for r in read_csv(spark, f"{tmp_dir}/q.csv").collect()), key=repr)
    assert ('say "hi"', 2.0) in rows and ("line one\nline two", 5.0) in rows and ("7", None) in rows
    assert len(rows) == 3


def test_manifest_reasons_and_dedupe(spark, files):
    m = source_manifest(spark, files)
    reasons = {r["name"]: r["reason"] for r in m.collect()}
    assert reasons["empty.csv"] == "Uploaded file is empty"
    assert reasons["note.txt"] == "Only CSV and Excel files are supported"
    assert reasons["utf8.csv"] is None
    assert m.filter("name = 'utf8.csv'").count() == 2
    assert dedupe_sources(m).filter("name = 'utf8.csv'").count() == 1


def test_write_then_read(spark, tmp_dir):
    df = spark.createDataFrame([(1, 10000000.0, " padded ", None), (2, 0.5, "x", "y")],
                               "k bigint, x double, t string, u string")
    write_csv(df, f"{tmp_dir}/out")
    back = read_csv(spark, f"{tmp_dir}/out")
    assert dict(back.dtypes) == {"k": "bigint", "x": "double", "t": "string", "u": "string"}
    assert sorted(tuple(r) for r in back.collect()) == [(1, 10000000.0, " padded ", None), (2, 0.5, "x", "y")]


def test_clean_files_each_alone(spark, files, tmp_dir):
    res = clean_files(spark, files, CleanRequest(), tmp_dir + "/cleaned")
    by = {r["name"]: r for r in res.collect()}
    assert by["note.txt"]["accepted"] is False and by["utf8.csv"]["accepted"] is True
    assert by["quoted.csv"]["accepted"] is False and "duplicate" in by["quoted.csv"]["reason"]
    assert by["empty.csv"]["reason"] == "Uploaded file is empty"


def test_replay_stream_each_file_alone(spark, tmp_dir):
    """Own encoding, own order of columns, own statistics, own output folder."""
    src = tmp_dir + "/in"
    _write(f"{src}/a/f.csv", b"a,b\n1,x\n1,x\n,y\n")
    _write(f"{src}/b/f.csv", 'b,a\n"caf\u00e9 \u20ac, ""q""",5\n"caf\u00e9 \u20ac, ""q""",5\n,7\n'.encode("cp1252"))
    out = tmp_dir + "/out"
    info = replay_stream(spark, src, CleanRequest(), out, files_per_batch=1)
    assert info["batches"] >= 2
    log = spark.read.parquet(f"{out}/log")
    assert log.select("path").distinct().count() == 2
    rows = sorted(tuple(r) for f in os.listdir(f"{out}/rows") for r in read_csv(spark, f"{out}/rows/{f}", infer_types=False).select("a", "b").collect())
    # each file is fitted alone: the first one's median fill is 1.0 (a float column), the other stays integral
    assert rows == [("1.0", "x"), ("1.0", "y"), ("5", "caf\u00e9 \u20ac, \"q\""), ("7", "caf\u00e9 \u20ac, \"q\"")]
    assert replay_stream(spark, src, CleanRequest(), out, checkpoint=info["checkpoint"])["batches"] == 0 or \
        spark.read.parquet(f"{out}/log").count() == log.count()


def test_headers_are_matched_by_name(spark, tmp_dir):
    _write(f"{tmp_dir}/h/one.csv", b"a,b\n1,x\n")
    _write(f"{tmp_dir}/h/two.csv", b"b,a\ny,2\n")
    assert sorted((r["a"], r["b"]) for r in read_csv(spark, f"{tmp_dir}/h").collect()) == [(1, "x"), (2, "y")]


def test_ragged_rows(spark, tmp_dir):
    _write(f"{tmp_dir}/long.csv", b"a,b\n1,2\n3,4,5\n")
    with pytest.raises(ValueError, match="long.csv"):
        read_csv(spark, f"{tmp_dir}/long.csv")
    _write(f"{tmp_dir}/short.csv", b"a,b\n1\n2,3\n")
    assert sorted((tuple(r) for r in read_csv(spark, f"{tmp_dir}/short.csv").collect()), key=repr) == [(1, None), (2, 3.0)]


def test_long_integers_are_not_lost(spark, tmp_dir):
    _write(f"{tmp_dir}/big.csv", b"a,b,c\n12345678901234567890,99999999999999999999999,1\n1,2,\n")
    df = read_csv(spark, f"{tmp_dir}/big.csv")
    assert [t for _, t in df.dtypes] == ["decimal(20,0)", "string", "double"]
    assert sorted((int(r["a"]), r["b"]) for r in df.collect()) == [(1, "2"), (12345678901234567890, "99999999999999999999999")]


def test_one_name_in_two_folders(spark, tmp_dir):
    _write(f"{tmp_dir}/in/a/x.csv", b"k\n1\n2\n")
    _write(f"{tmp_dir}/in/b/x.csv", b"k\n3\n4\n5\n")
    done = clean_files(spark, f"{tmp_dir}/in", CleanRequest(), f"{tmp_dir}/out").collect()
    assert all(r["accepted"] for r in done) and len({r["output"] for r in done}) == 2


def test_booleans_are_written_as_python_prints_them(spark, tmp_dir):
    write_csv(spark.createDataFrame([(True,), (False,)], "b boolean"), f"{tmp_dir}/bool")
    assert sorted(r["b"] for r in spark.read.option("header", True).csv(f"{tmp_dir}/bool").collect()) == ["False", "True"]


def test_corrupt_preset_file(spark, tmp_dir):
    from tabclean.sources.presets import list_presets, load_request, save_preset
    store = f"{tmp_dir}/presets"
    save_preset(spark, store, " mine ", CleanRequest(keep_columns=["k"]))
    _write(f"{store}/part-bad.parquet", b"not parquet")
    rows = list_presets(spark, store).collect()
    assert [r["name"] for r in rows] == ["mine"] and load_request(rows[0]).keep_columns == ["k"]


def test_listing_of_many_files(spark, tmp_dir):
    """Nested, empty, hidden and oddly named files, without a call a file."""
    from tabclean.sources.csv import list_files
    for i in range(300):
        _write(f"{tmp_dir}/many/d{i % 40}/f {i}+;.csv", b"" if i % 10 == 0 else b"a\n1\n")
    _write(f"{tmp_dir}/many/_hidden.csv", b"x")
    _write(f"{tmp_dir}/many/d0/.dot.csv", b"x")
    got = list_files(spark, f"{tmp_dir}/many").collect()
    assert len(got) == 300 and sum(r["length"] == 0 for r in got) == 30 and all(r["modificationTime"] is not None for r in got)
    assert {r["path"].rsplit("/", 1)[1] for r in got} == {f"f {i}+;.csv" for i in range(300)}
    assert source_manifest(spark, [f"{tmp_dir}/many/d0", f"{tmp_dir}/many/d1"]).count() == 16
