import datetime as dt

from pyspark.sql import functions as F

from qalytics.functions import elapsed_days, json_value, listagg_distinct, parse_day


def test_json_value_scalars_only(spark):
    df = spark.createDataFrame(
        [('{"a":"x","o":{"b":1},"l":[1],"t":true,"n":null,"i":12}',), ("not json",), (None,)], "j string")
    got = df.select(*[json_value("j", k).alias(k) for k in ("a", "o", "l", "t", "n", "i", "missing")]).collect()
    assert tuple(got[0]) == ("x", None, None, "true", None, "12", None)
    assert all(v is None for r in got[1:] for v in r)


def test_parse_day_lenient_digits_strict_calendar(spark):
    df = spark.createDataFrame([("2024-1-5",), ("1998-02-30",), ("n/a",), ("1998-06-01",)], "s string")
    got = [r[0] for r in df.select(parse_day("s")).collect()]
    assert got == [dt.datetime(2024, 1, 5), None, None, dt.datetime(1998, 6, 1)]


def test_listagg_distinct_sorted_and_null_when_empty(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "g int, v string")
    got = dict(df.groupBy("g").agg(listagg_distinct(F.col("v")).alias("s")).collect())
    assert got == {1: "a, b", 2: None}


def test_elapsed_days_truncates_whole_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 3, 9)),
                                (dt.datetime(2024, 1, 3, 9), dt.datetime(2024, 1, 1, 10))], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(elapsed_days("a", "b")).collect()] == [1, -1]
