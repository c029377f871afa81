import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import arithmetic, encoding, labels, text


def evaluate(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("v"))).orderBy("i").collect()]


AGES = {
    "18 Years": 18, "6 Months": 1, "30 Months": 2, "3 Weeks": 1, "104 Weeks": 2, "30 Days": 30,
    "N/A": None, "": None, "18.5 Years": None, "x Months": None, " 21 YEARS ": 21, None: None,
    "   ": None, "40": 40, "-5 Months": 1,
}

DATES = {
    "2019-03-05": dt.date(2019, 3, 5), "2019-3-5": dt.date(2019, 3, 5),
    " 2019-03-05 ": dt.date(2019, 3, 5), "March 2019": dt.date(2019, 3, 1),
    "MARCH 2019": dt.date(2019, 3, 1), "March   2019": dt.date(2019, 3, 1),
    "2019": dt.date(2019, 1, 1), "2019-03": None, "Mar 2019": None, "March 5, 2019": None,
    "2019-02-30": None, "12019": None, "Foo 2019": None, "": None, None: None,
}


def test_age_text(spark):
    assert evaluate(spark, AGES, "string", text.age_years) == list(AGES.values())


def test_date_text(spark):
    assert evaluate(spark, DATES, "string", text.registry_date) == list(DATES.values())


@pytest.mark.parametrize(
    "conditions, area",
    [
        (["Liver Cancer"], "Oncology"),
        (["Liver Cirrhosis"], "Hepatology"),
        (["Archive Study"], "Infectious Disease"),
        (["Pulmonary Hypertension"], "Cardiology"),
        (["healthy", "LUPUS"], "Rheumatology"),
        ([], "Other"),
        (None, "Other"),
    ],
)
def test_area(spark, conditions, area):
    rows = spark.createDataFrame([(conditions,)], "c array<string>")
    rows = rows.select(text.joined_conditions(F.col("c")).alias("t"))
    assert rows.select(text.therapeutic_area("t")).first()[0] == area


def test_every_keyword_alone_gives_its_area(spark):
    rows = spark.createDataFrame(list(C.AREA_KEYWORDS), "t string, area string")
    got = {r[0]: r[1] for r in rows.select("t", text.therapeutic_area("t")).collect()}
    assert got == dict(C.AREA_KEYWORDS)


@pytest.mark.parametrize(
    "status, results, success, confidence",
    [
        ("COMPLETED", True, True, 0.85),
        ("completed", False, True, 0.60),
        ("SUSPENDED", True, False, 0.90),
        ("TERMINATED", False, False, 0.90),
        ("WITHDRAWN", False, False, 0.90),
        ("RECRUITING", True, None, 0.0),
        (None, True, None, 0.0),
    ],
)
def test_outcome(spark, status, results, success, confidence):
    row = spark.createDataFrame([(status, results)], "s string, r boolean").select(
        labels.outcome_success(F.col("s")), labels.outcome_confidence(F.col("s"), F.col("r"))
    )
    assert tuple(row.first()) == (success, confidence)


def test_confidence_bands(spark):
    bands = {0.76: "High", 0.75: "Medium", 0.61: "Medium", 0.55: "Low", 0.24: "High", 0.25: "Medium"}
    assert evaluate(spark, bands, "double", labels.confidence_band) == list(bands.values())


def test_traffic_light(spark):
    lights = {0.6: "green", 0.595: "green", 0.594: "yellow", 0.4: "yellow", 0.394: "red", 0.0: "red"}
    assert evaluate(spark, lights, "double", labels.traffic_light) == list(lights.values())


def test_percent_is_exact_half_up(spark):
    rows = spark.createDataFrame(
        [(124_899, 200_000), (1, 3), (1, 16), (1, 2000), (0, 5), (5, 5), (0, 0)], "s long, n long"
    )
    got = [r[0] for r in rows.select(arithmetic.percent(F.col("s"), F.col("n"))).collect()]
    assert got == [62.4, 33.3, 6.3, 0.1, 0.0, 100.0, None]


def test_rounded_ratio(spark):
    rows = spark.createDataFrame([(1, 3), (1, 20_000), (2, 3)], "s long, n long")
    got = [r[0] for r in rows.select(arithmetic.rounded_ratio(F.col("s"), F.col("n"), 4)).collect()]
    assert got == [0.3333, 0.0001, 0.6667]


def test_bins(spark):
    edges = {49: "<50", 50: "50-200", 199: "50-200", 4999: "1K-5K", 5000: ">5K"}
    got = evaluate(spark, edges, "int", lambda v: encoding.bin_label(v, C.ENROLLMENT_BINS))
    assert got == list(edges.values())


def test_text_truncation(spark):
    got = evaluate(spark, ["abc", "", None, "abcdef"], "string", lambda v: text.none_if_empty(v, 4))
    assert got == ["abc", None, None, "abcd"]
