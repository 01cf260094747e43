"""CSV inference, the columnar file, statistics and registration."""

import random

import pytest

from kestrelq.catalog import Catalog, table_stats
from kestrelq.errors import BindError, StorageError
from kestrelq.sources.colfile import TAG, batches, read_colfile, read_header, read_layout, write_colfile
from kestrelq.sources.csv_source import read_csv


def write(tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_text(text)
    return str(path)


def test_csv_types_do_not_depend_on_order(spark, tmp_path):
    text = "f1,f2,b,none,day,mixed,big,odd,neg\n1.5,2,TRUE,,2020-01-01,5,9223372036854775808,1d,-1\n2,1.5,false,,2020-01-02,x,1,t,+2\n,,,,,,,,\n"
    df = read_csv(spark, write(tmp_path, text))
    assert dict(df.dtypes) == {"f1": "double", "f2": "double", "b": "boolean", "none": "string", "day": "string", "mixed": "string", "big": "double", "odd": "string", "neg": "bigint"}
    assert [tuple(r)[:3] for r in df.collect()] == [(1.5, 2.0, True), (2.0, 1.5, False), (None, None, None)]


def test_csv_quotes_and_numbers(spark, tmp_path):
    df = read_csv(spark, write(tmp_path, 'id,s,t,n\n1,"a,b","x""y",NaN\n2, lead ,z,1e5\n'))
    assert [tuple(r)[:3] for r in df.collect()] == [(1, "a,b", 'x"y'), (2, " lead ", "z")]
    assert dict(df.dtypes)["n"] == "double"


def _plain_record(line):
    out, now, quoted, i = [], "", False, 0
    while i < len(line):
        if line[i] == '"' and quoted and line[i + 1 : i + 2] == '"':
            now, i = now + '"', i + 1
        elif line[i] == '"':
            quoted = not quoted
        elif line[i] == "," and not quoted:
            out, now = [*out, now], ""
        else:
            now += line[i]
        i += 1
    return None if quoted else [*out, now]


def test_csv_quotes_anywhere_in_a_field(spark):
    from pyspark.sql import functions as F

    from kestrelq.sources.csv_source import ends, fields

    rng = random.Random(9)
    lines = ["", ",", 'ab"c,d"e,f', 'x"y""z"w', '""', '"""",a', 'a""b,"c"" ""d"', *("".join(rng.choice('ab, "') for _ in range(rng.randint(0, 14))) for _ in range(400)), '"' + "long, " * 50_000 + '",1']
    found = spark.createDataFrame([(x,) for x in lines], "line string").select("line", fields(F.col("line")).alias("f"), ends(F.col("line")).alias("ok")).collect()
    assert all((r.f if r.ok else None) == _plain_record(r.line) for r in found)


def test_csv_of_a_folder(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text(f'id,"na,me"\n{k},x"{k},"y\n')
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path)).collect()) == [(k, f"x{k},y") for k in range(3)]
    with pytest.raises(StorageError):
        read_csv(spark, write(tmp_path, 'a,b\n1,"2\n'))


def test_csv_arity(spark, tmp_path):
    with pytest.raises(StorageError):
        read_csv(spark, write(tmp_path, "a,b\n1,2\n3\n4,5,6\n")).select("a").collect()


def test_colfile_round_trip(spark, tmp_path):
    rows = [(7, "Ada", 1.5, True), (None, None, None, None), (-1, "é😀", float("inf"), False)]
    df = spark.createDataFrame(rows, "id bigint, name string, x double, ok boolean")
    path = str(tmp_path / "t.col")
    assert write_colfile(df, path, "people") == 3
    assert open(path, "rb").read(4) == TAG and read_header(path) == ("people", 4, 3)
    assert sorted(map(tuple, read_colfile(spark, path).collect()), key=repr) == sorted(rows, key=repr)
    catalog = Catalog(spark)
    catalog.colfile(path)
    assert catalog.table_names() == ["people"] and catalog.table("PEOPLE").count() == 3


def test_colfile_streams_batches_and_folders(spark, tmp_path):
    rows = [(i if i % 3 else None, "s" * (i % 7)) for i in range(1000)]
    for k in range(2):
        write_colfile(spark.createDataFrame(rows, "a bigint, s string").coalesce(1), str(tmp_path / f"f{k}"), "t")
    sizes = [b.num_rows for b in batches(str(tmp_path / "f0"), 300)]
    assert sizes == [300, 300, 300, 100]
    df = read_colfile(spark, f"file:{tmp_path}")
    assert df.rdd.getNumPartitions() == 2 and sorted(map(tuple, df.collect()), key=repr) == sorted(rows * 2, key=repr)


def test_column_sizes(spark):
    catalog = Catalog(spark)
    catalog.register("t", spark.createDataFrame([(1, "éa", True), (None, None, None)], "a bigint, s string, b boolean"))
    assert catalog.column_sizes("t") == {"a": 8, "s": 3, "b": 1}


def test_colfile_rejects(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"nope")
    with pytest.raises(StorageError):
        read_header(str(tmp_path / "x"))
    with pytest.raises(StorageError):
        write_colfile(spark.sql("SELECT array(1) AS a"), str(tmp_path / "y"), "y")
    path = str(tmp_path / "cut")
    write_colfile(spark.range(5), path, "r")
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-3])
    with pytest.raises(StorageError):
        read_layout(path)
    with pytest.raises(StorageError):
        read_colfile(spark, path)


def test_statistics(spark):
    df = spark.createDataFrame([(2, "b"), (1, None)], "id bigint, name string")
    found = table_stats(df)
    assert found.rows == 2
    assert (found.columns["id"].least, found.columns["id"].greatest, found.columns["id"].distinct, found.columns["name"].nulls) == (1, 2, 2, 1)


def test_catalog(spark):
    catalog = Catalog(spark)
    catalog.from_rows("T", "a bigint, x double", [(1, 2)])
    assert catalog.table("t").first().x == 2.0 and catalog.size_in_bytes("t") > 0
    catalog.from_rows("t", "a bigint", [])
    assert catalog.table("T").count() == 0 and catalog.stats("t").rows == 0
    with pytest.raises(BindError):
        catalog.table("u")
    with pytest.raises(StorageError):
        catalog.from_rows("v", "a bigint", [(1, 2)])
    with pytest.raises(StorageError):
        catalog.from_rows("v", "a bigint", [("x",)])
