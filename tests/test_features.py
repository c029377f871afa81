from math import log1p

import pytest

from cohortlens.constants import FEATURE_COLUMNS
from cohortlens.operators.model import complete_designs
from cohortlens.operators.splits import engineer_features

SCHEMA = (
    "nct_id string, phase string, sponsor_class string, intervention_types array<string>,"
    " therapeutic_area string, enrollment int, duration_days int, number_of_arms int,"
    " locations_count int, countries array<string>, eligibility_min_age int,"
    " eligibility_max_age int"
)
BASE = {
    "nct_id": "T7", "phase": "PHASE2", "sponsor_class": "NETWORK",
    "intervention_types": ["DEVICE", "DRUG"], "therapeutic_area": "Neurology", "enrollment": 84,
    "duration_days": 411, "number_of_arms": 3, "locations_count": 7,
    "countries": ["Chile", "Kenya", "Norway"], "eligibility_min_age": 21,
    "eligibility_max_age": 68,
}


@pytest.fixture
def features(spark):
    def run(**changes):
        row = {**BASE, **changes}
        df = spark.createDataFrame([tuple(row[f.split()[0]] for f in SCHEMA.split(", "))], SCHEMA)
        return engineer_features(df, keep=()).first().asDict()

    return run


def test_base_trial(features):
    got = features()
    assert tuple(got) == FEATURE_COLUMNS
    expected = [2, 4, 2, 2, log1p(84), log1p(411), 3, log1p(7), 3, 21, 68, 0, 1, 1, 1, 0, 0]
    assert list(got.values()) == pytest.approx(expected, abs=1e-12)


def test_missing_values_have_flags_and_no_nulls(features):
    got = features(duration_days=None, eligibility_max_age=None, locations_count=None)
    assert None not in got.values()
    assert (got["enrollment_missing"], got["duration_missing"]) == (0.0, 1.0)
    assert (got["duration_days_log"], got["eligibility_max_age"], got["locations_count_log"]) == (0.0, 65.0, pytest.approx(log1p(1)))
    assert features(enrollment=None)["enrollment_missing"] == 1.0


def test_all_null(features):
    got = features(**{k: None for k in BASE if k != "nct_id"})
    expected = [-1, 5, 9, 10, 0, 0, 1, log1p(1), 1, 18, 65, 0, 0, 0, 0, 1, 1]
    assert list(got.values()) == pytest.approx(expected)


@pytest.mark.parametrize(
    "change, feature, value",
    [
        ({"sponsor_class": "NIH"}, "is_industry_sponsored", 0),
        ({"sponsor_class": "industry"}, "is_industry_sponsored", 1),
        ({"sponsor_class": "OTHER"}, "sponsor_class_encoded", 5),
        ({"sponsor_class": "FED"}, "sponsor_class_encoded", 2),
        ({"countries": ["a", "b", "c"]}, "is_international", 1),
        ({"countries": ["a"]}, "is_international", 0),
        ({"countries": None}, "n_countries", 1),
        ({"countries": []}, "n_countries", 0),
        ({"phase": "PHASE1/PHASE2"}, "phase_numeric", 1.5),
        ({"phase": "phase1"}, "phase_numeric", -1),
        ({"intervention_types": ["RADIATION", "drug"]}, "intervention_type_encoded", 0),
        ({"intervention_types": ["RADIATION", "drug"]}, "has_drug_intervention", 1),
        ({"intervention_types": ["RADIATION"]}, "intervention_type_encoded", 9),
        ({"intervention_types": []}, "has_drug_intervention", 0),
        ({"number_of_arms": 0}, "number_of_arms", 1),
        ({"number_of_arms": 99}, "number_of_arms", 20),
        ({"locations_count": 0}, "locations_count_log", 0),
        ({"locations_count": 1}, "is_multicenter", 0),
        ({"therapeutic_area": "Podiatry"}, "therapeutic_area_encoded", 10),
    ],
)
def test_single_feature(features, change, feature, value):
    assert features(**change)[feature] == value


def test_orderings(features):
    assert features(phase="PHASE1")["phase_numeric"] < features(phase="PHASE3")["phase_numeric"]
    assert features(enrollment=10_000)["enrollment_log"] > features(enrollment=10)["enrollment_log"]


def test_design_defaults(spark):
    designs = spark.createDataFrame([(1, "PHASE2", None)], "id int, phase string, number_of_arms int")
    row = engineer_features(complete_designs(designs, ("id",)), keep=("id",)).first()
    assert row["number_of_arms"] == 2 and row["n_countries"] == 0
    assert row["locations_count_log"] == pytest.approx(log1p(10))
    assert (row["eligibility_min_age"], row["eligibility_max_age"]) == (18, 65)
    assert (row["enrollment_missing"], row["therapeutic_area_encoded"]) == (1, 10)
