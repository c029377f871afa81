"""Table and document schemas, as DDL strings every Spark reader accepts."""

TRIALS_DDL = """
    nct_id string, title string, brief_summary string, overall_status string,
    phase string, study_type string, conditions array<string>,
    therapeutic_area string, intervention_types array<string>,
    intervention_names array<string>, sponsor_name string, sponsor_class string,
    enrollment int, enrollment_type string, number_of_arms int,
    number_of_groups int, start_date date, primary_completion_date date,
    completion_date date, duration_days int, has_results boolean,
    primary_outcome_measure string, primary_outcome_timeframe string,
    locations_count int, countries array<string>, eligibility_min_age int,
    eligibility_max_age int, eligibility_gender string, outcome_success boolean,
    outcome_confidence double, raw_json string, ingested_at timestamp,
    updated_at timestamp
"""

# What the study normaliser writes: the trials table without the columns the
# table itself maintains (group count and the two bookkeeping timestamps).
NORMALISED_COLUMNS = (
    "nct_id", "title", "brief_summary", "overall_status", "phase", "study_type",
    "conditions", "therapeutic_area", "intervention_types", "intervention_names",
    "sponsor_name", "sponsor_class", "enrollment", "enrollment_type",
    "number_of_arms", "start_date", "primary_completion_date", "completion_date",
    "duration_days", "has_results", "primary_outcome_measure",
    "primary_outcome_timeframe", "locations_count", "countries",
    "eligibility_min_age", "eligibility_max_age", "eligibility_gender",
    "outcome_success", "outcome_confidence", "raw_json",
)

PREDICTIONS_DDL = """
    nct_id string, model_version string, features map<string,double>,
    predicted_proba double, predicted_label boolean, actual_label boolean,
    correct boolean, created_at timestamp
"""

MODEL_METRICS_DDL = """
    model_version string, accuracy double, precision_score double,
    recall_score double, f1_score double, auc_roc double, cv_auc_mean double,
    cv_auc_std double, n_train long, n_test long,
    feature_importance map<string,double>, trained_at timestamp
"""

INGESTION_JOBS_DDL = """
    job_id string, job_type string, status string, records_fetched long,
    records_inserted long, records_updated long, error_message string,
    started_at timestamp, finished_at timestamp
"""

MESSAGES_DDL = "conv_id long, turn long, role string, text string"

SAVED_ANALYSES_DDL = """
    conversation_id string, query string, chart_type string, chart_data string,
    insight_text string, created_at timestamp
"""

# One page of the registry feed. Studies stay raw text here, so that one bad
# study cannot spoil its page and the original document is kept as it came.
CORRUPT_COLUMN = "_corrupt_record"
PAGE_DDL = f"studies array<string>, nextPageToken string, {CORRUPT_COLUMN} string"

STUDY_DDL = f"""
    protocolSection struct<
        identificationModule: struct<nctId: string, briefTitle: string>,
        statusModule: struct<
            overallStatus: string,
            startDateStruct: struct<date: string>,
            primaryCompletionDateStruct: struct<date: string>,
            completionDateStruct: struct<date: string>>,
        descriptionModule: struct<briefSummary: string>,
        designModule: struct<
            phases: array<string>, studyType: string,
            enrollmentInfo: struct<count: int, type: string>,
            armGroups: array<map<string, string>>, numberArms: int>,
        armsInterventionsModule: struct<
            interventions: array<struct<type: string, name: string>>>,
        conditionsModule: struct<conditions: array<string>>,
        sponsorCollaboratorsModule: struct<
            leadSponsor: struct<name: string, class: string>>,
        outcomesModule: struct<
            primaryOutcomes: array<struct<measure: string, timeFrame: string>>>,
        eligibilityModule: struct<
            minimumAge: string, maximumAge: string, sex: string>,
        contactsLocationsModule: struct<locations: array<struct<country: string>>>>,
    resultsSection map<string, string>,
    hasResults boolean,
    {CORRUPT_COLUMN} string
"""

# The parts of a study that the normaliser reads, and the columns it makes from
# each without looking at another column.
STUDY_PARTS = {
    "identificationModule": ("nct_id", "title"),
    "statusModule": ("overall_status", "start_date", "primary_completion_date", "completion_date"),
    "descriptionModule": ("brief_summary",),
    "designModule": ("phase", "study_type", "enrollment", "enrollment_type", "number_of_arms"),
    "armsInterventionsModule": ("intervention_types", "intervention_names"),
    "conditionsModule": ("conditions",),
    "sponsorCollaboratorsModule": ("sponsor_name", "sponsor_class"),
    "outcomesModule": ("primary_outcome_measure", "primary_outcome_timeframe"),
    "eligibilityModule": ("eligibility_min_age", "eligibility_max_age", "eligibility_gender"),
    "contactsLocationsModule": ("locations_count", "countries"),
    "resultsSection": ("has_results",),
    "hasResults": ("has_results",),
}
