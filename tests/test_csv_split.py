"""Splittable multi-line CSV: pandas' rows at any split size, more than one task per file, positions, errors."""

import os
import random
import tempfile

import pandas as pd
import pytest

from tabtext.sources.csv import read_csv
from tabtext.sources.csv_split import read_numbered, zip_by_position


def write(text, name="f.csv", folder=None):
    p = os.path.join(folder or tempfile.mkdtemp(prefix="tabtext-csv-"), name)
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return p


def messy(n, seed, end="\n"):
    rng = random.Random(seed)
    cells = ["plain", "", '"a ""quoted"" word"', '"line\nend"', '"\n"', '"a,b"', '""', '"""\n"""', "1.5", '"x\n\n\ny"', "é日本", '"tail\n"', '","']
    return end.join(["a,b,c", *(",".join([str(i), rng.choice(cells), rng.choice(cells[:9])]) for i in range(n))]) + end


@pytest.mark.parametrize("size", [16, 61, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_pandas_at_any_split_size(spark, size, end):
    p = write(messy(150, size, end))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_numbered(spark, p)
        got = sorted(map(tuple, df.collect()))
        if size <= 61:
            assert spark.read.option("lineSep", "\n").text(p).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    want = pd.read_csv(p, dtype=str, keep_default_na=False)
    assert [(r[0], *(v or "" for v in r[1:])) for r in got] == [(i, *r) for i, r in enumerate(want.itertuples(index=False, name=None))]


def test_blank_lines_folders_and_errors(spark):
    folder = tempfile.mkdtemp(prefix="tabtext-csv-")
    write('a,b\n1,"x\n\ny"\n\n2,z\n', "part-0.csv", folder)
    write('a,b\n\n3,w', "part-1.csv", folder)
    assert sorted(map(tuple, read_numbered(spark, folder).collect())) == [(0, "1", "x\n\ny"), (1, "2", "z"), (2, "3", "w")]
    with pytest.raises(ValueError, match="doesn't end"):
        read_numbered(spark, write('a,b\n1,"open\n2,x\n'))
    write("b,a\n3,w\n", "part-2.csv", folder)
    with pytest.raises(ValueError, match="different headers"):
        read_numbered(spark, folder)
    with pytest.raises(ValueError, match="no header"):
        read_numbered(spark, write(""))
    assert read_numbered(spark, write('a,"b ""c"""\n')).columns == ["number", "a", 'b "c"']


def test_zip_in_file_order(spark):
    left = read_numbered(spark, write("t\n" + "\n".join(f'"row\n{i}"' for i in range(50)) + "\n"))
    right = read_numbered(spark, write("p\n" + "\n".join(str(i * i) for i in range(50)) + "\n")).repartition(7)
    got = sorted(map(tuple, zip_by_position(left, right).collect()))
    assert got == [(i, f"row\n{i}", str(i * i)) for i in range(50)]
    with pytest.raises(ValueError, match="50 rows cannot be zipped with 3"):
        zip_by_position(left, right.filter("number < 3"))


def test_read_csv_types(spark):
    df = read_csv(spark, write('s,n\n"a\nb",1\nNA,2\n'))
    assert dict(df.dtypes) == {"s": "string", "n": "bigint"} and {tuple(r) for r in df.collect()} == {("a\nb", 1), (None, 2)}
