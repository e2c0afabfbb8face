import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from clickloom.functions import clean
from clickloom.plans.prepare import Preparation, prepare_files
from clickloom.sinks import logs as sinks
from clickloom.sources import calendar, images, logs
from clickloom.spec import Continuous, HashBucket, Identity, ModelSpec

SPEC = ModelSpec(
    ("clk", "Id", "site", "kind", "age", "note"), (HashBucket("site", 10), Identity("kind", 5), Continuous("age"))
)


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(text)


def test_decode_defaults_quotes_and_trailing_fields(spark, tmp_path):
    lines = [
        '1\ta\ts"x\t3\t2.5\tback\\slash',
        "0\tb\t-\t\t-\t",
        "\tc\t\tzz\t1e1\t\"q, r\"",
        "-\td\ta,b\t4\t\t",
    ]
    put(f"{tmp_path}/20240101/part-0", "\n".join(lines) + "\n")
    put(f"{tmp_path}/20240101/_SUCCESS", "")
    put(f"{tmp_path}/20240101/.hidden", "9\tx\n")
    raw = logs.scan_days(spark, str(tmp_path), ["20240101"], list(SPEC.fields))
    got = {r["id"]: tuple(r) for r in clean.typed_decode(raw, SPEC).collect()}
    assert got == {
        "a": (1, "a", 's"x', 3, 2.5, "back\\slash"),
        "b": (0, "b", "", 0, 0.0, ""),
        "c": (0, "c", "", 0, 10.0, '"q, r"'),
        "d": (0, "d", "a,b", 4, 0.0, ""),
    }
    assert clean.typed_decode(raw, SPEC, with_label=False).columns == SPEC.names("all")
    assert [r["n_rows"] for r in logs.per_file_counts(raw).collect()] == [4]


def test_split_keeps_trailing_empty_fields(spark):
    lines = spark.createDataFrame([("a\tb\t\t",), ("x",)], "value string")
    rows = logs.named_columns(logs.split_fields(lines), ["A", "B", "C", "D"]).collect()
    assert {tuple(r) for r in rows} == {("a", "b", "", ""), ("x", None, None, None)}
    assert rows[0].__fields__ == ["a", "b", "c", "d"]


def test_multivalue_tokens(spark):
    df = spark.createDataFrame([("a,,b,",), ("",), (None,), ("x",), (",",)], "c string")
    got = [r[0] for r in df.select(clean.split_multivalue(F.col("c"))).collect()]
    assert got == [["a", "b"], [], [], ["x"], []]


def test_class_weight_defaults(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "y int")
    weights = df.select(clean.class_weight(F.col("y"), negative=0.2)).collect()
    assert [r[0] for r in weights] == [1.0, 0.2, 0.2]


def test_days_and_defaults():
    assert logs.run_days("20240228", "20240301") == ["20240228", "20240229", "20240301"]
    assert logs.run_days(today=date(2024, 5, 6)) == ["20240506"]
    assert logs.load_day(today=date(2024, 3, 1)) == "20240229"
    assert logs.days_back("20240301", 3) == ["20240301", "20240229", "20240228"]


def test_calendar(spark):
    df = spark.createDataFrame([(date(2024, 3, 1), date(2024, 3, 3))], "a date, b date")
    back = calendar.trailing_dates(df, "a", 3).select(calendar.day_text(F.col("trailing"))).collect()
    assert [r[0] for r in back] == ["20240301", "20240229", "20240228"]
    assert [str(r[0]) for r in calendar.date_range(df, "a", "b").collect()] == ["2024-03-01", "2024-03-02", "2024-03-03"]


def test_missing_day_stops_the_run(spark, tmp_path):
    for day in ("20240101", "20240103"):
        put(f"{tmp_path}/in/{day}/part-0", "1\tr\ts\t1\t2\tn\n")
    job = Preparation(features=("site",), windows=(1, 3), keep=1.0)
    with pytest.raises(FileNotFoundError, match="20240102"):
        prepare_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", ["20240103"], list(SPEC.fields), "id", job)
    assert not os.path.exists(f"{tmp_path}/out")


FIELDS = ["clk", "id", "site", "dt"]


def test_prepared_directories(spark, tmp_path):
    log = {
        "20240101": ["1\ta\tx\t20240101", "0\tb\tx\t20240101"],
        "20240102": ["0\tc\tx\t20240102", "0\td\t\t20240102"],
        "20240103": ["1\te\tx\t20240103", "1\tf\t\t20240103", "0\tg\tx\t20240103"],
    }
    for day, lines in log.items():
        put(f"{tmp_path}/in/{day}/part-0", "\n".join(lines) + "\n")
    job = Preparation(features=("site",), windows=(1, 2), keep=1.0)
    days = ["20240102", "20240103"]
    for _ in range(2):  # the second run replaces the output of the first
        prepare_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", days, FIELDS, "id", job)
    assert sorted(d for d in os.listdir(f"{tmp_path}/out") if "=" in d) == [f"run_dt={d}" for d in days]
    got = logs.scan_days(spark, f"{tmp_path}/out", days, [*FIELDS, "r1", "r2"], "run_dt={day}").collect()
    rates = {r["id"]: (round(float(r["r1"]), 4), round(float(r["r2"]), 4)) for r in got}
    assert rates == {
        "c": (0.0, 0.3333), "d": (0.0, 0.0), "e": (0.5, 0.3333), "f": (1.0, 0.5), "g": (0.5, 0.3333),
    }


def test_stored_counts_replace_old_days(spark, tmp_path):
    """A second run needs raw input for its own day only and gives the rates of the full history."""
    first = {"20240101": ["1\ta\tx\t20240101", "0\tb\tx\t20240101"], "20240102": ["0\tc\tx\t20240102"]}
    second = {"20240103": ["1\te\tx\t20240103", "1\tf\t\t20240103", "0\tg\tx\t20240103"]}
    for folder, log in (("one", first), ("two", second), ("all", first | second)):
        for day, lines in log.items():
            put(f"{tmp_path}/{folder}/{day}/part-0", "\n".join(lines) + "\n")
    early = Preparation(features=("site",), windows=(2,), keep=1.0)
    job = Preparation(features=("site",), windows=(1, 3), keep=1.0)

    def run(source, target, day, what, counts):
        prepare_files(spark, f"{tmp_path}/{source}", f"{tmp_path}/{target}", [day], FIELDS, "id", what, counts=counts)
        names = [*FIELDS, *[f"r{k}" for k in what.windows]]
        return sorted(tuple(r) for r in logs.scan_days(spark, f"{tmp_path}/{target}", [day], names, "run_dt={day}").collect())

    counts = f"{tmp_path}/counts"
    run("one", "out", "20240102", early, counts)
    stored = run("two", "out", "20240103", job, counts)
    assert stored == run("all", "plain", "20240103", job, None) and len(stored) == 3
    assert run("two", "again", "20240103", job, counts) == stored
    with pytest.raises(FileNotFoundError, match="20231231"):
        run("two", "out", "20240102", job, counts)


def prepared(spark, base, days, job, counts=None, label="clk"):
    prepare_files(spark, f"{base}/in", f"{base}/out", days, FIELDS, "id", job, label=label, counts=counts)
    names = [*FIELDS, *[f"r{k}" for k in job.windows]]
    rows = logs.scan_days(spark, f"{base}/out", days, names, "run_dt={day}").collect()
    return {r["id"]: round(float(r[f"r{job.windows[-1]}"]), 4) for r in rows}


def test_directories_decide_the_day(spark, tmp_path):
    put(f"{tmp_path}/in/20240101/p", "1\ta\tx\t20240101\n1\tb\tx\t-\n0\tc\tx\tnonsense\n")
    put(f"{tmp_path}/in/20240102/p", "0\td\tx\t20240101\n0\te\tx\t20240102\n")
    job = Preparation(features=("site",), windows=(1,), keep=1.0)
    two = Preparation(features=("site",), windows=(1, 2), keep=1.0)
    counts = f"{tmp_path}/counts"
    assert prepared(spark, tmp_path, ["20240101"], job, counts) == {"a": 0.6667, "b": 0.6667, "c": 0.6667}
    for stored in (counts, None):  # the late row neither replaces the first day's counts nor gets lost
        assert prepared(spark, tmp_path, ["20240102"], two, stored) == {"d": 0.4, "e": 0.4}


def test_changed_inputs_are_counted_again(spark, tmp_path):
    put(f"{tmp_path}/in/20240101/p", "1\ta\t0\tz\n0\tb\t0\tz\n")
    put(f"{tmp_path}/in/20240102/p", "0\tc\t0\tz\n")
    job = Preparation(features=("site",), windows=(2,), keep=1.0)
    counts = f"{tmp_path}/counts"
    assert prepared(spark, tmp_path, ["20240102"], job, counts) == {"c": 0.3333}
    assert prepared(spark, tmp_path, ["20240102"], Preparation(features=("dt",), windows=(2,), keep=1.0), counts) == {"c": 0.3333}
    assert prepared(spark, tmp_path, ["20240102"], job, counts, label="site") == {"c": 0.0}  # another label
    assert prepared(spark, tmp_path, ["20240102"], job, counts) == {"c": 0.3333}
    put(f"{tmp_path}/in/20240101/p", "")  # delivered again, now empty
    assert prepared(spark, tmp_path, ["20240102"], job, counts) == {"c": 0.0}


def test_tsv_round_trip_and_file_count(spark, tmp_path):
    rows = [(str(i), f' q"{i} ', "a,b" if i % 2 else "") for i in range(50)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    sinks.write_tsv(df, f"{tmp_path}/t", files=2)
    assert len([f for f in os.listdir(f"{tmp_path}/t") if f.startswith("part-")]) == 2
    back = logs.scan_days(spark, f"{tmp_path}", ["t"], ["a", "b", "c"]).fillna("").collect()
    assert sorted(tuple(r) for r in back) == sorted(rows)


def test_days_are_replaced_one_by_one(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "x string, day string")
    sinks.write_days(df, f"{tmp_path}/d", "day")
    sinks.write_days(spark.createDataFrame([("c", "2")], "x string, day string"), f"{tmp_path}/d", "day")
    assert {tuple(r) for r in logs.scan_partitions(spark, f"{tmp_path}/d", ["x"]).select("x").collect()} == {("a",), ("c",)}


def test_partition_filter_prunes(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "x string, dt string")
    sinks.write_days(df, f"{tmp_path}/d", "dt")
    read = logs.scan_partitions(spark, f"{tmp_path}/d", ["x"]).where("dt = '2'")
    assert [tuple(r) for r in read.collect()] == [("b", "2")]
    assert "PartitionFilters: [isnotnull(dt" in read._jdf.queryExecution().executedPlan().toString()


def test_large_days_are_exported_in_several_files(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("string"), F.when(F.col("id") < 900, "1").otherwise("2").alias("day"))
    sinks.export_days(df, f"{tmp_path}/e", "day", "id", files=3)
    files = {d: len([f for f in os.listdir(f"{tmp_path}/e/day={d}") if f.endswith(".csv")]) for d in "12"}
    assert files == {"1": 3, "2": 3}
    assert spark.read.text(f"{tmp_path}/e").count() == 1000
    sinks.export_days(df.withColumn("day", F.nullif("day", F.lit("2"))), f"{tmp_path}/n", "day", "id")
    files = [len([f for f in os.listdir(f"{tmp_path}/n/{d}") if f.endswith(".csv")]) for d in os.listdir(f"{tmp_path}/n") if "=" in d]
    assert files == [1, 1]
    assert spark.read.text(f"{tmp_path}/n").count() == 1000


def test_copied_days(spark, tmp_path):
    lines = ["1\ta", "", " padded \t x ", '0\t"b', "one", "a\tb\tc\td", "\t"]
    put(f"{tmp_path}/in/20240101/p", "\n".join(lines) + "\n")
    put(f"{tmp_path}/in/20240102/p", "1\tc\n")
    sinks.copy_days(spark, f"{tmp_path}/in", f"{tmp_path}/out", ["20240101", "20240102"])
    folder = f"{tmp_path}/out/day=20240101"
    copied = "".join(open(f"{folder}/{f}").read() for f in os.listdir(folder) if f.startswith("part"))
    assert copied == "\n".join(lines) + "\n"
    assert logs.available_days(spark, f"{tmp_path}/out", ["20240102", "20240103"], "day={day}") == ["20240102"]


def test_binary_sources(spark, tmp_path):
    os.makedirs(f"{tmp_path}/img/sub")
    for name, data in {"a.raw": bytes(range(12)), "sub/b.raw": bytes([255] * 12)}.items():
        with open(f"{tmp_path}/img/{name}", "wb") as handle:
            handle.write(data)
    files = {r["file"]: (r["length"], bytes(r["image"])) for r in images.image_files(spark, f"{tmp_path}/img").collect()}
    assert files == {"a.raw": (12, bytes(range(12))), "b.raw": (12, bytes([255] * 12))}
    records = images.fixed_records(spark, f"{tmp_path}/img/a.raw", 4).collect()
    assert sorted(bytes(r["image"]) for r in records) == [bytes(range(i, i + 4)) for i in (0, 4, 8)]
    images.write_image_table(images.image_files(spark, f"{tmp_path}/img"), f"{tmp_path}/table")
    assert images.read_image_table(spark, f"{tmp_path}/table").count() == 2
