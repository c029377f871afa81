import json

import pytest
from pyspark.sql import functions as F

from cohortlens import schemas
from cohortlens.operators import upsert
from cohortlens.operators.normalize import normalise, parts_for
from cohortlens.plans import fixtures as X
from cohortlens.schemas import NORMALISED_COLUMNS
from cohortlens.sources import studies, synthetic, tables


def study(nct_id="NCT1", **modules):
    protocol = {"identificationModule": {"nctId": nct_id, "briefTitle": "A title"}, **modules}
    return {"protocolSection": protocol}


def rows_of(spark, documents):
    texts = [(d if isinstance(d, str) else json.dumps(d),) for d in documents]
    return studies.parse_studies(spark.createDataFrame(texts, "raw_json string"))


def flatten(spark, document):
    return normalise(rows_of(spark, [document])).first()


def test_missing_modules_take_defaults(spark):
    row = flatten(spark, {"protocolSection": {}})
    assert (row["nct_id"], row["title"], row["overall_status"], row["sponsor_name"]) == ("", "", "", "")
    assert row["eligibility_gender"] == "ALL" and row["therapeutic_area"] == "Other"
    assert (row["phase"], row["enrollment"], row["number_of_arms"], row["brief_summary"]) == (None,) * 4
    assert (row["conditions"], row["countries"], row["intervention_types"]) == ([], [], [])
    assert (row["locations_count"], row["has_results"]) == (0, False)
    assert (row["outcome_success"], row["outcome_confidence"]) == (None, 0.0)


def test_full_document(spark):
    document = study(
        statusModule={
            "overallStatus": "COMPLETED",
            "startDateStruct": {"date": "2019-03-05"},
            "primaryCompletionDateStruct": {"date": "April 2019"},
        },
        descriptionModule={"briefSummary": "s" * 2500},
        designModule={
            "phases": ["PHASE1", "PHASE2"], "studyType": "INTERVENTIONAL",
            "enrollmentInfo": {"count": 12, "type": "ACTUAL"},
            "armGroups": [{"label": "a", "interventionNames": ["x", "y"]}, {"label": "b"}],
            "numberArms": 9,
        },
        armsInterventionsModule={
            "interventions": [{"type": "DRUG", "name": f"n{i}"} for i in range(7)]
            + [{"type": "", "name": ""}, {"name": "last"}, {"type": "DEVICE"}]
        },
        conditionsModule={"conditions": ["Liver Cancer"]},
        outcomesModule={"primaryOutcomes": [{"measure": "m" * 600, "timeFrame": "t" * 300}]},
        eligibilityModule={"minimumAge": "6 Months", "maximumAge": "65 Years", "sex": "FEMALE"},
        contactsLocationsModule={
            "locations": [{"country": "B"}, {"country": "A"}, {"country": "B"}, {"country": ""}, {}]
        },
    )
    document["resultsSection"] = {"participantFlowModule": {"groups": [1, 2]}}
    row = flatten(spark, document)
    assert row["phase"] == "PHASE1" and row["number_of_arms"] == 2
    assert len(row["brief_summary"]) == 2000
    assert (len(row["primary_outcome_measure"]), len(row["primary_outcome_timeframe"])) == (500, 200)
    assert row["intervention_types"] == ["DRUG", "DEVICE"]
    assert row["intervention_names"] == ["n0", "n1", "n2", "n3", "n4"]
    assert row["countries"] == ["B", "A"] and row["locations_count"] == 5
    assert row["duration_days"] == 27 and row["completion_date"] is None
    assert (row["eligibility_min_age"], row["eligibility_max_age"]) == (1, 65)
    assert (row["has_results"], row["outcome_success"], row["outcome_confidence"]) == (True, True, 0.85)
    assert json.loads(row["raw_json"]) == document


@pytest.mark.parametrize(
    "extra, expected",
    [
        ({"resultsSection": {}}, False),
        ({"resultsSection": {}, "hasResults": True}, True),
        ({"hasResults": False}, False),
        ({"resultsSection": {"a": 1}, "hasResults": False}, True),
    ],
)
def test_has_results(spark, extra, expected):
    assert flatten(spark, {**study(), **extra})["has_results"] is expected


@pytest.mark.parametrize(
    "start, primary, completion, days",
    [
        ("2020-01-10", None, "2020-01-01", 0),
        ("2020-01-01", "2020-01-11", None, 10),
        (None, "2020-01-11", "2020-01-11", None),
        ("2020-01-01", None, None, None),
        ("2020-01-01", "2020-01-11", "2019-13", 10),
    ],
)
def test_duration(spark, start, primary, completion, days):
    dates = {
        "startDateStruct": {"date": start}, "primaryCompletionDateStruct": {"date": primary},
        "completionDateStruct": {"date": completion},
    }
    assert flatten(spark, study(statusModule=dates))["duration_days"] == days


def test_number_of_arms_without_groups(spark):
    row = flatten(spark, study(designModule={"armGroups": [], "numberArms": 3}))
    assert row["number_of_arms"] == 3


def test_bad_studies_and_pages_are_set_aside(spark, tmp_path):
    good = study("NCT1")
    odd = study("NCT2", designModule={"enrollmentInfo": {"count": "many"}})
    (tmp_path / "one.json").write_text(json.dumps({"studies": [good, odd], "nextPageToken": "x"}))
    (tmp_path / "two.json").write_text('{"studies": [')
    pages = studies.read_pages(spark, str(tmp_path))
    (tmp_path / "three.json").write_text('{"studies": []}')
    (tmp_path / "four.json").write_text("{}")
    fine, bad = studies.split_studies(studies.parse_studies(studies.open_pages(pages)))
    assert [r["nct_id"] for r in normalise(fine).collect()] == ["NCT1"]
    bad = {r["page_file"].rsplit("/", 1)[1]: r for r in bad.collect()}
    assert sorted(bad) == ["one.json", "two.json"]
    assert json.loads(bad["one.json"]["raw_json"]) == odd and bad["one.json"]["position"] == 1
    assert bad["two.json"]["raw_json"] == '{"studies": [' and bad["two.json"]["position"] is None


def test_pages_hold_a_bounded_number_of_studies(spark):
    rows = rows_of(spark, [study(f"NCT{i}") for i in range(5)])
    assert studies.pages_of(rows, F.lit(1), size=5).count() == 1
    with pytest.raises(Exception, match="more than 4 studies"):
        studies.pages_of(rows, F.lit(1), size=4).collect()


# --- table maintenance -------------------------------------------------------


def normalised(spark, pairs):
    documents = [study(key, descriptionModule={"briefSummary": text}) for key, text in pairs]
    order = {json.dumps(d): i for i, d in enumerate(documents)}
    rows = normalise(rows_of(spark, documents))
    number = spark.createDataFrame(list(order.items()), "raw_json string, seen int")
    return rows.join(number, "raw_json")


def test_upsert_table(spark, tmp_path):
    first = tables.upsert_trials(
        spark, None, normalised(spark, [("A", "a1"), ("B", "b1"), ("B", "b2")]), ["seen"],
        str(tmp_path / "one"),
    )
    assert (first.inserted, first.updated) == (2, 0)
    before = {r["nct_id"]: r for r in tables.read_trials(spark, first.snapshot).collect()}
    batch = normalised(spark, [("B", "b3"), ("C", "c1"), ("B", "b4")])
    second = tables.upsert_trials(spark, first.snapshot, batch, ["seen"], str(tmp_path / "two"))
    assert (second.inserted, second.updated) == (1, 1)
    after = {r["nct_id"]: r for r in tables.read_trials(spark, second.snapshot).collect()}
    assert {k: r["brief_summary"] for k, r in after.items()} == {"A": "a1", "B": "b4", "C": "c1"}
    assert after["A"] == before["A"]
    assert after["B"]["ingested_at"] == before["B"]["ingested_at"]
    assert after["B"]["updated_at"] > before["B"]["updated_at"]
    again = tables.upsert_trials(spark, second.snapshot, batch, ["seen"], str(tmp_path / "three"))
    assert (again.inserted, again.updated) == (0, 2)
    drop = ["updated_at"]
    one, two = (tables.read_trials(spark, x.snapshot).drop(*drop) for x in (second, again))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_append_absent(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.with_bookkeeping(normalised(spark, [("A", "a1")]).drop("seen")).write.parquet(path)
    more = tables.with_bookkeeping(normalised(spark, [("A", "a2"), ("B", "b1"), ("B", "b2")]))
    tables.append_absent(spark, path, more, ["seen"])
    got = {r["nct_id"]: r["brief_summary"] for r in tables.read_trials(spark, path).collect()}
    assert got == {"A": "a1", "B": "b1"}


def test_latest_per_key(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), ("b", 1, "w")], "k string, n int, v string")
    got = sorted(tuple(r) for r in upsert.latest_per_key(rows, ["k"], ["n"]).collect())
    assert got == [("a", 3, None), ("b", 1, "w")]


def test_job_log(spark, tmp_path):
    log = str(tmp_path / "log")
    tables.run_logged(spark, log, "job1", lambda: tables.Ingested("s", 3, 2))
    with pytest.raises(RuntimeError):
        tables.run_logged(spark, log, "job2", lambda: (_ for _ in ()).throw(RuntimeError("boom")))
    rows = spark.read.parquet(log)
    assert rows.count() == 4
    states = {r["job_id"]: r for r in tables.job_states(rows).collect()}
    one, two = states["job1"], states["job2"]
    assert (one["status"], one["records_fetched"], one["records_inserted"], one["records_updated"]) == (
        "completed", 5, 3, 2,
    )
    assert (two["status"], two["error_message"]) == ("failed", "boom")
    assert one["finished_at"] is not None


def test_predictions_are_replaced_by_version(spark, tmp_path):
    path = str(tmp_path / "p")

    def frame(version, n):
        return spark.range(n).select(
            F.col("id").cast("string").alias("nct_id"), F.lit(version).alias("model_version"),
            F.lit(0.5).alias("predicted_proba"),
        )

    tables.write_predictions(frame("v1", 3), path)
    tables.write_predictions(frame("v2", 4), path)
    tables.write_predictions(frame("v1", 5), path)
    counts = {r["model_version"]: r["count"] for r in spark.read.parquet(path).groupBy("model_version").count().collect()}
    assert counts == {"v1": 5, "v2": 4}


# --- synthetic trials --------------------------------------------------------


def test_synthetic_trials_do_not_depend_on_partitioning(spark):
    one = synthetic.generate_trials(spark.range(0, 500, 1, 1))
    many = synthetic.generate_trials(spark.range(0, 500, 1, 7))
    assert one.exceptAll(many).isEmpty() and one.count() == 500
    assert set(one.columns) == set(schemas.NORMALISED_COLUMNS)


def test_synthetic_trials_keep_to_their_ranges(spark):
    row = synthetic.generate_trials(spark.range(4000)).agg(
        F.min("enrollment"), F.min("duration_days"), F.max("duration_days"), F.min("start_date"),
        F.max("start_date"), F.min(F.size("countries")), F.max(F.size("countries")),
        F.avg((F.col("overall_status") == "COMPLETED").cast("int")), F.min("nct_id"),
        F.percentile("enrollment", 0.5),
    ).first()
    assert row[0] >= 10 and row[1] >= 180 and row[2] <= 2000
    assert str(row[3]) >= "2005-01-01" and str(row[4]) <= "2020-12-31"
    assert (row[5], row[6]) == (1, 3) and abs(row[7] - 0.55) < 0.03
    assert row[8] == "NCT90000000" and 130 < row[9] < 170


def test_parts_of_a_study_give_the_same_columns(spark):
    good = {
        "protocolSection": {
            "identificationModule": {"nctId": "NCT1", "briefTitle": "t"},
            "statusModule": {"overallStatus": "COMPLETED", "startDateStruct": {"date": "2020"}, "completionDateStruct": {"date": "May 2021"}},
            "designModule": {"phases": ["PHASE2"], "enrollmentInfo": {"count": 7}, "numberArms": 2},
            "conditionsModule": {"conditions": ["Asthma"]},
            "contactsLocationsModule": {"locations": [{"country": "PERU"}, {"country": "PERU"}]},
        },
        "resultsSection": {"a": "b"},
    }
    texts = [json.dumps(good), json.dumps(good).replace("7", '"many"'), json.dumps(good)[:-30], "{}", "no json", None]
    rows = spark.createDataFrame([(t,) for t in texts], "raw_json string")
    whole = normalise(studies.parse_studies(rows))
    for column in NORMALISED_COLUMNS:
        some = normalise(studies.parse_studies(rows, parts_for((column,))), columns=(column,))
        assert some.columns == [column]
        assert list(map(str, some.collect())) == list(map(str, whole.select(column).collect())), column


@pytest.mark.parametrize("mask, expected", [(0b11, ["Breast Cancer", "Type 2 Diabetes"]), (1 << 17 | 1, ["Breast Cancer", "COPD"]), (0, []), (None, None)])
def test_names_of_a_mask_are_in_order(spark, mask, expected):
    names = X._members(F.lit(mask).cast("long"), X.BRAND_CONDITIONS)
    assert spark.range(1).select(names.alias("n")).first().n == expected
    every = spark.range(1).select(X._members(F.lit(2**25 - 1).cast("long"), X.BRAND_CONDITIONS).alias("n")).first().n
    assert every == sorted(X.BRAND_CONDITIONS)
