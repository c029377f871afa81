"""Fixed values of the trial data model.

Everything in this file is contract, not logic: word lists, code tables, bin
edges and thresholds whose exact values decide the results.
"""

# --- Fixed values: outcome label by status -------------------------------
COMPLETED_STATUSES = ("COMPLETED",)
FAILED_STATUSES = ("TERMINATED", "WITHDRAWN", "SUSPENDED")
DEFAULT_INGEST_STATUSES = ("COMPLETED", "TERMINATED", "WITHDRAWN")
CONFIDENCE_WITH_RESULTS = 0.85
CONFIDENCE_COMPLETED = 0.60
CONFIDENCE_FAILED = 0.90
CONFIDENCE_UNKNOWN = 0.0

# --- Fixed values: condition keyword -> area, first hit in list order wins -
AREA_KEYWORDS = (
    ("neoplasm", "Oncology"),
    ("cancer", "Oncology"),
    ("carcinoma", "Oncology"),
    ("leukemia", "Oncology"),
    ("lymphoma", "Oncology"),
    ("tumor", "Oncology"),
    ("diabetes", "Endocrinology"),
    ("insulin", "Endocrinology"),
    ("cardiovascular", "Cardiology"),
    ("heart", "Cardiology"),
    ("cardiac", "Cardiology"),
    ("hypertension", "Cardiology"),
    ("alzheimer", "Neurology"),
    ("parkinson", "Neurology"),
    ("depression", "Psychiatry"),
    ("schizophrenia", "Psychiatry"),
    ("anxiety", "Psychiatry"),
    ("infection", "Infectious Disease"),
    ("hiv", "Infectious Disease"),
    ("covid", "Infectious Disease"),
    ("pneumonia", "Infectious Disease"),
    ("asthma", "Respiratory"),
    ("copd", "Respiratory"),
    ("pulmonary", "Respiratory"),
    ("arthritis", "Rheumatology"),
    ("lupus", "Rheumatology"),
    ("kidney", "Nephrology"),
    ("renal", "Nephrology"),
    ("liver", "Hepatology"),
    ("hepat", "Hepatology"),
)
OTHER_AREA = "Other"

# --- Fixed values: feature code tables ------------------------------------
PHASE_CODES = {
    "EARLY_PHASE1": 0.0,
    "PHASE1": 1.0,
    "PHASE1/PHASE2": 1.5,
    "PHASE2": 2.0,
    "PHASE2/PHASE3": 2.5,
    "PHASE3": 3.0,
    "PHASE4": 4.0,
    "NA": -1.0,
}
PHASE_DEFAULT = -1.0
SPONSOR_CODES = {
    "INDUSTRY": 0.0,
    "NIH": 1.0,
    "OTHER_GOV": 2.0,
    "FED": 2.0,
    "INDIVIDUAL": 3.0,
    "NETWORK": 4.0,
    "AMBIG": 5.0,
    "UNKNOWN": 5.0,
}
SPONSOR_DEFAULT = 5.0
INTERVENTION_CODES = {
    "DRUG": 0.0,
    "BIOLOGICAL": 1.0,
    "DEVICE": 2.0,
    "PROCEDURE": 3.0,
    "BEHAVIORAL": 4.0,
    "DIAGNOSTIC_TEST": 5.0,
    "DIETARY_SUPPLEMENT": 6.0,
    "GENETIC": 7.0,
    "COMBINATION_PRODUCT": 8.0,
    "OTHER": 9.0,
}
INTERVENTION_DEFAULT = 9.0
AREA_CODES = {
    "Oncology": 0.0,
    "Cardiology": 1.0,
    "Neurology": 2.0,
    "Psychiatry": 3.0,
    "Endocrinology": 4.0,
    "Infectious Disease": 5.0,
    "Respiratory": 6.0,
    "Rheumatology": 7.0,
    "Nephrology": 8.0,
    "Hepatology": 9.0,
    "Other": 10.0,
}
AREA_DEFAULT = 10.0

# --- Fixed values: order of the model input columns ------------------------
FEATURE_COLUMNS = (
    "phase_numeric",
    "sponsor_class_encoded",
    "intervention_type_encoded",
    "therapeutic_area_encoded",
    "enrollment_log",
    "duration_days_log",
    "number_of_arms",
    "locations_count_log",
    "n_countries",
    "eligibility_min_age",
    "eligibility_max_age",
    "is_industry_sponsored",
    "is_multicenter",
    "is_international",
    "has_drug_intervention",
    "enrollment_missing",
    "duration_missing",
)

# --- Fixed values: chart bins as (exclusive upper edge, label); None = rest -
ENROLLMENT_BINS = (
    (50, "<50"),
    (200, "50-200"),
    (500, "200-500"),
    (1000, "500-1K"),
    (5000, "1K-5K"),
    (None, ">5K"),
)
ENROLLMENT_BINS_COMPACT = (
    (50, "<50"),
    (200, "50-200"),
    (500, "200-500"),
    (1000, "500-1K"),
    (None, ">1K"),
)
DURATION_BINS = (
    (180, "<6 months"),
    (365, "6-12 months"),
    (730, "1-2 years"),
    (1825, "2-5 years"),
    (None, ">5 years"),
)
DURATION_BINS_COMPACT = (
    (180, "<6mo"),
    (365, "6-12mo"),
    (730, "1-2yr"),
    (None, ">2yr"),
)

# --- Fixed values: limits, truncation lengths, thresholds ------------------
SEARCH_LIMIT = 100
SPONSOR_LIMIT = 50
BENCHMARK_LIMIT = 5000
PAGE_SIZE = 100
MIN_SPONSOR_TRIALS = 3
SPONSOR_CHART_ROWS = 6
SUMMARY_CHARS = 2000
MEASURE_CHARS = 500
TIMEFRAME_CHARS = 200
INTERVENTION_NAMES_KEPT = 5
TITLE_CHARS = 60
MIN_TRAINING_CONFIDENCE = 0.6
MIN_TRAINING_ROWS = 100
ALARM_THRESHOLD = 10
ALARM_PERIODS = 2
REQUEST_LIMIT = 120
CHAT_REQUEST_LIMIT = 30

# --- Fixed values: dimension allow-lists -----------------------------------
STATISTIC_DIMENSIONS = ("phase", "therapeutic_area", "sponsor_class", "overall_status")
COMPARE_DIMENSIONS = ("sponsor_class", "phase", "therapeutic_area")
