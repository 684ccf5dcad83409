"""CSV readers: preamble lines, several missing-value markers, header normalisation, source order."""

from scenaria.session import scratch_path
from scenaria.sources.files import read_csv_na_tokens, read_csv_skip_preamble


def _write_text(spark, lines, name):
    path = scratch_path(spark, name)
    spark.createDataFrame([(ln,) for ln in lines], "value string").coalesce(1).write.text(path)
    return path


def test_skip_preamble(spark):
    path = _write_text(spark, ['"Data Source","World Development Indicators",', "",
                               '"Last Updated Date","2020-07-01",',
                               '"Country Name","Country Code","x2018","x2019"',
                               '"Aruba","ABW","1.0E+09",""', '"World","WLD","8.7E+13","8.8E+13"'], "pre")
    df = read_csv_skip_preamble(spark, path, ["country_name", "country_code", "x2018", "x2019"], "country_code",
                                numeric=["x2018", "x2019"])
    got = {r.country_code: (r.x2018, r.x2019) for r in df.collect()}
    assert got == {"ABW": (1.0e9, None), "WLD": (8.7e13, 8.8e13)}


def test_na_tokens_and_order(spark):
    path = _write_text(spark, ["country.code,total,non.health", "AFG,637030150,-", "AGO,NA,", "ALB,1.06E+11,#VALUE!",
                               "AFG,1,2"], "na")
    df = read_csv_na_tokens(spark, path, ["country.code", "total", "non.health"], ["total", "non_health"],
                            order_col="src")
    rows = sorted(df.collect(), key=lambda r: (r.src.file, r.src.pos))
    assert df.columns == ["country_code", "total", "non_health", "src"]
    assert [(r.country_code, r.total, r.non_health) for r in rows] == [
        ("AFG", 637030150.0, None), ("AGO", None, None), ("ALB", 1.06e11, None), ("AFG", 1.0, 2.0)]


def test_each_file_is_bound_by_its_own_header(spark):
    import pytest

    path = scratch_path(spark, "two-headers")
    for lines in (["code,total", "AFG,1", "AGO,-", '"A, B",3'], ["total,code,note", "2,ALB,x", "total,code,note", "5,AND", "6,ARE,y,z", "", "7,,"]):
        spark.createDataFrame([(ln,) for ln in lines], "value string").coalesce(1).write.mode("append").text(path)
    df = read_csv_na_tokens(spark, path, ["code", "total"], ["total"], order_col="src")
    assert {(r.code, r.total) for r in df.collect()} == {("AFG", 1.0), ("AGO", None), ("A, B", 3.0), ("ALB", 2.0), (None, 7.0)}
    assert df.lines.counts() == {"lines": 7, "rejected": 2}
    assert {r.line for r in df.lines.rejects.collect()} == {"5,AND", "6,ARE,y,z"}
    assert len({r.file for r in df.lines.rejects.collect()}) == 1
    with pytest.raises(ValueError, match="no column .'note'"):
        read_csv_na_tokens(spark, path, ["code", "note"])


def test_empty_files_and_folders_of_headers(spark):
    path = _write_text(spark, ["code,total"], "head-only")
    df = read_csv_na_tokens(spark, path, ["code", "total"], ["total"])
    assert df.collect() == [] and df.lines.counts() == {"lines": 0, "rejected": 0}


def test_lines_left_out_of_a_preamble_file_are_counted(spark):
    path = _write_text(spark, ["made by,", '"Country Code","x"', "ABW,1", "not a code,2", "WLD,3"], "pre-count")
    df = read_csv_skip_preamble(spark, path, ["code", "x"], "code", numeric=["x"])
    assert df.count() == 2 and df.observed.get == {"lines": 5, "rejected": 3}
    left = read_csv_skip_preamble(spark, path, ["code", "x"], "code", rejects=True)
    assert {r.code for r in left.collect()} == {"made by", "Country Code", "not a code"}


def test_exports_are_published_at_once(spark):
    import os

    import pytest
    from pyspark.sql import functions as F

    from scenaria.sources.files import export_indexed, published, read_published

    path, schema = scratch_path(spark, "published"), "row_index long, k string"
    with pytest.raises(FileNotFoundError):
        read_published(spark, path, schema)

    def export(keys, df=None):
        export_indexed(df if df is not None else spark.createDataFrame([(k,) for k in keys], "k string"), path, ["k"])

    def read():
        return sorted(tuple(r) for r in read_published(spark, path, schema).collect())
    export("ba")
    assert read() == [(1, "a"), (2, "b")] and published(spark, path)["rows"] == 2
    broken = spark.createDataFrame([("x",), ("y",)], "k string").withColumn("k", F.when(F.col("k") == "y", F.raise_error(F.lit("killed"))).otherwise(F.col("k")))
    with pytest.raises(Exception, match="killed"):
        export("", broken)
    assert read() == [(1, "a"), (2, "b")], "the old export stays whole"
    held = read_published(spark, path, schema)
    export("c")
    assert read() == [(1, "c")] and held.count() == 2, "who reads the old one may finish"
    export("d")
    local = path.removeprefix("file:")
    assert len([x for x in os.listdir(local) if x.startswith("data-")]) == 2
