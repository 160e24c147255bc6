"""Records of files that are read in parts, against the reading of whole files by the csv module and by Spark."""

import csv
import random
import tempfile

import pytest

from sentrace.sources import logs, records


def write(rows, end="\n", copies=1):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/log.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["id", "text", "last"])
        for _ in range(copies):
            out.writerows(rows)
    return path


def texts(n=300):
    random.seed(8)
    pieces = ['say "hi"', "\n", "\r\n", ",", '"', '""', "ä", "x" * 40, ',"', '",\n', "\n\n", " ", "end\r"]
    return [(str(i), "".join(random.choice(pieces) for _ in range(random.randrange(9))), random.choice(["", "z", "\n", "q\n\nr"])) for i in range(n)]


def rows_of(df):
    return sorted((r["id"], r["text"] or "", r["last"] or "") for r in df.collect())


@pytest.fixture
def parts(spark):
    """Sets the bytes of a part of a file."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    yield lambda n: [spark.conf.set(k, str(n)) for k in keys]
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize(
    "size, max_shared, end", [(17, 0, "\n"), (17, 10**6, "\r\n"), (400, 0, "\r\n"), (400, 10**6, "\n"), (1 << 27, 10**6, "\n")]
)
def test_records_equal_the_whole_file(spark, parts, size, max_shared, end, monkeypatch):
    rows = texts(30 if size == 17 else 200)
    path = write(rows, end)
    parts(size)
    found = records.csv_records
    monkeypatch.setattr(logs, "csv_records", lambda s, p: found(s, p, max_shared=max_shared))
    assert rows_of(logs.read_csv(spark, path)) == sorted(rows)


def test_many_tasks_read_one_file(spark, parts):
    path = write(texts(), copies=20)
    parts(8000)
    assert records._lines(spark, path).rdd.getNumPartitions() > 20
    whole = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    assert rows_of(logs.read_csv(spark, path)) == rows_of(whole)


def test_one_field_over_many_parts(spark, parts):
    rows = [("1", "a\n" * 1000, "b"), ("2", "c", "d"), ("3", "e\n\n" * 300 + '"', "\n")]
    path = write(rows)
    parts(200)
    assert rows_of(logs.read_csv(spark, path)) == sorted(rows)


def test_quotes_inside_plain_fields(spark, parts):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/log.csv"
    with open(path, "w") as f:
        f.write('id,text,last\n1,5" disk,x\n2,"a\nb",y\n3,6" and 7",z\n\n4,"c ""d""\n",w\n')
    parts(5)
    assert rows_of(logs.read_csv(spark, path)) == [("1", '5" disk', "x"), ("2", "a\nb", "y"), ("3", '6" and 7"', "z"), ("4", 'c "d"\n', "w")]


def test_plain_files_are_left_to_spark(spark):
    path = write([(str(i), "a, b", "c") for i in range(50)])
    assert records.csv_records(spark, path) is None
    assert logs.read_csv(spark, path).count() == 50
    assert "Scan csv" in logs.read_csv(spark, path)._jdf.queryExecution().executedPlan().toString().replace("FileScan", "Scan")


def test_empty_files_and_other_headers(spark):
    assert rows_of(logs.read_csv(spark, write([]))) == []
    a, b = write([("1", "x\ny", "z")]), write([("2", "x\ny", "z")])
    assert rows_of(logs.read_csv(spark, [a, b])) == [("1", "x\ny", "z"), ("2", "x\ny", "z")]
    with open(b) as f:
        text = f.read().replace("text", "other")
    with open(b, "w") as f:
        f.write(text)
    with pytest.raises(ValueError, match="another header"):
        logs.read_csv(spark, [a, b])
    with open(a, "a") as f:
        f.write('9,"never closed\n10,x,y\n')
    assert logs.read_csv(spark, a).count() == 2
