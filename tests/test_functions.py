import datetime

from pyspark.sql import functions as F

from sparkgauge.functions import dates, normalize, text


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("x")).first()["x"]


def test_names_places_and_categories(spark):
    cases = [
        (normalize.project_name, "Smith & Sons Energy, LLC", "smith and sons"), (normalize.project_name, "LLC", None), (normalize.project_name, "  ", None), (normalize.project_name, "NaN", None),
        (normalize.county, "el paso County", "El Paso"), (normalize.county, "VAN-zandt", "Van-zandt"), (normalize.county, "123", None), (normalize.state, "texas", "TX"), (normalize.state, "nm", "NM"), (normalize.state, "Oklahoma", "OK"),
        (normalize.fuel, "Solar + Storage", "Hybrid"), (normalize.fuel, "solar storage", "Battery"), (normalize.fuel, "Electric", "Gas"), (normalize.fuel, "Nuclear", "Other"), (normalize.fuel, None, "Unknown"), (normalize.fuel, "Photovoltaic", "Solar"),
        (normalize.status, "Inactive", "Suspended"), (normalize.status, "incomplete", "Completed"), (normalize.status, "under review", "Active"), (normalize.status, "??", "Unknown"), (normalize.status, "Cancelled", "Withdrawn"),
        (normalize.capacity, "1,250.5 MW", 1250.5), (normalize.capacity, "-3", -3.0), (normalize.capacity, "n/a", None),
        (normalize.date, "2026-01-31", datetime.date(2026, 1, 31)), (normalize.date, "1/5/2026", datetime.date(2026, 1, 5)), (normalize.date, "soon", None), (normalize.date, "2026-01-31 00:00:00", datetime.date(2026, 1, 31)),
    ]
    for f, value, expected in cases:
        assert one(spark, value, f("v")) == expected, (f.__name__, value)


def test_headers_resolve_by_order_of_aliases():
    assert normalize.resolve_headers(["Queue No", "INR", "Capacity (MW)", "MW"]) == {"queue_id": "Queue No", "capacity_mw": "Capacity (MW)"}
    assert "point_of_interconnection" not in normalize.resolve_headers(["POI Location"])


def test_text_helpers(spark):
    assert one(spark, "  a \t b ", text.clean_text("v")) == "a b"
    assert one(spark, "null", text.clean_text("v")) is None
    assert one(spark, "HV Switchgear / GIS", text.slug("v")) == "hv_switchgear__gis"
    assert one(spark, "x", text.stable_json({"b": F.lit(None).cast("string"), "a": F.col("v")})) == '{"a":"x","b":null}'
    assert one(spark, "A final order", text.keywords_in("v", ("final", "order", "pending"))) == ["final", "order"]
    assert one(spark, "watch_flex_r1", text.without_prefix("v", "watch_flex_")) == "r1"
    assert one(spark, datetime.date(2024, 7, 10), text.month_age("v", F.lit("2026-06-05").cast("date")), "date") == 23
    assert one(spark, datetime.date(2024, 2, 10), text.month_label(text.month_end("v")), "date") == "2024_02"
    assert one(spark, None, text.differs("v", F.lit("a"))) is True
    assert one(spark, None, text.first_present(F.lit(" nan "), F.lit("b"))) == "b"


def test_quality_flags(spark):
    raw = spark.createDataFrame([("", "", "odd", "", "-1")], "Project string, County string, Fuel string, Status string, MW string")
    row = normalize.normalize(raw, "M", "s", "2026-01-31", F.lit("1")).first()
    assert row["data_quality_flags"] == ["missing_queue_id", "missing_project_name", "unclear_fuel_type:odd", "unclear_status:missing", "missing_or_nonpositive_capacity_mw", "missing_county"]


def test_dates_of_any_format(spark):
    day = datetime.date(2026, 3, 4)
    given = ["2026-03-04", "2026/3/4", "2026.03.04", "20260304", "3/4/2026", "03-04-26", "3/4/2026 5:06 PM", "2026-03-04T05:06:07Z", "4 March 2026", "4-Mar-26", "Mar 4, 2026", "march 4 2026", " 3/4/2026 "]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*given, "13/4/2026", "4/13/2026", "31/31/2026", "Foo 4, 2026", "30 Feb 2026", "", "n/a", None, "1/1/68", "1/1/69"])], "i int, v string")
    got = [r["d"] for r in rows.select("i", dates.parse("v").alias("d")).orderBy("i").collect()]
    assert got == [day] * len(given) + [datetime.date(2026, 4, 13)] * 2 + [None] * 6 + [datetime.date(2068, 1, 1), datetime.date(1969, 1, 1)]
    assert rows.where("i = 4").select(dates.parse("v", day_first=True)).first()[0] == datetime.date(2026, 4, 3)


def test_columns_vote_on_day_and_month(spark):
    rows = [("a", "3/4/2026", "3/4/2026"), ("a", "13/4/2026", "4/13/2026"), ("a", "14/4/2026", None), ("b", "3/4/2026", "3/4/2026"), ("b", "4/13/2026", "13/4/2026"), (None, "3/4/2026", "25.12.2026")]
    df = spark.createDataFrame(rows, "`f.n` string, x string, `y.z` string")
    got = [(r["f.n"], r["x"].isoformat(), r["y.z"] and r["y.z"].isoformat()) for r in dates.voted(df, ["x", "y.z"], ["f.n"]).collect()]
    assert sorted(got, key=str) == sorted([("a", "2026-04-03", "2026-03-04"), ("a", "2026-04-13", "2026-04-13"), ("a", "2026-04-14", None), ("b", "2026-03-04", "2026-04-03"), ("b", "2026-04-13", "2026-04-13"), (None, "2026-03-04", "2026-12-25")], key=str)
    assert dates.voted(df.limit(0), ["x"], ["f.n"]).count() == 0
    raw = spark.createDataFrame([("s1", "Q1", "3/4/2026"), ("s1", "Q2", "30/4/2026"), ("s2", "Q1", "3/4/2026")], "sid string, `Queue ID` string, `Request Date` string")
    found = normalize.normalize(raw, "M", F.col("sid"), F.lit("2026-01-01"), "Queue ID", vote_by=["sid"])
    assert {(r["snapshot_id"], r["queue_id"]): r["request_date"].isoformat() for r in found.collect()} == {("s1", "Q1"): "2026-04-03", ("s1", "Q2"): "2026-04-30", ("s2", "Q1"): "2026-03-04"}
