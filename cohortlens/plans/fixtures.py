"""Adapters that derive trial tables from the provided star-schema tables.

Every adapter is a lazy DataFrame over whole tables. ``trials`` takes the list
of columns a query needs and joins only the tables these columns come from;
beyond that, column pruning is left to the optimiser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.constants import PAGE_SIZE
from cohortlens.functions import labels
from cohortlens.functions.text import joined_conditions, therapeutic_area
from cohortlens.operators.evaluation import overall_metrics
from cohortlens.sources.studies import pages_of

# --- Fixed values: how table codes read as trial values --------------------
BRAND_CONDITIONS = (
    "Breast Cancer", "Type 2 Diabetes", "Heart Failure", "Alzheimer Disease",
    "Major Depression", "HIV Infections", "Asthma", "Rheumatoid Arthritis",
    "Chronic Kidney Disease", "Liver Cirrhosis", "Healthy Volunteers", "Liver Cancer",
    "Archive Study", "Pulmonary Hypertension", "Hepatitis C", "Parkinson Disease",
    "Schizophrenia", "COPD", "Lupus Nephritis", "Renal Cell Carcinoma", "Obesity",
    "Insulin Resistance", "COVID-19", "Migraine", "Psoriasis",
)
PART_INTERVENTIONS = (
    ("ECONOMY", "DRUG"),
    ("STANDARD", "BIOLOGICAL"),
    ("PROMO", "DEVICE"),
    ("SMALL", "PROCEDURE"),
    ("LARGE", "BEHAVIORAL"),
    ("MEDIUM", "RADIATION"),
)
SEGMENT_CLASSES = (
    ("AUTOMOBILE", "INDUSTRY"),
    ("BUILDING", "NIH"),
    ("FURNITURE", "OTHER_GOV"),
    ("MACHINERY", "NETWORK"),
    ("HOUSEHOLD", "OTHER"),
)
PRIORITY_PHASES = (("1", "PHASE1"), ("2", "PHASE2"), ("3", "PHASE3"), ("5", "PHASE4"))

_CUSTOMER = {"sponsor_name", "sponsor_class"}
_PART = {
    "title", "brief_summary", "conditions", "therapeutic_area", "intervention_types",
    "intervention_names", "eligibility_min_age", "eligibility_max_age",
    "primary_outcome_measure",
}
_SUPPLIER = {"countries"}
_LINES = _PART | _SUPPLIER | {
    "number_of_arms", "primary_completion_date", "completion_date", "duration_days",
    "locations_count", "primary_outcome_timeframe",
}

TRIAL_COLUMNS = (
    "nct_id", "title", "brief_summary", "overall_status", "phase", "study_type",
    "conditions", "therapeutic_area", "intervention_types", "intervention_names",
    "sponsor_name", "sponsor_class", "enrollment", "enrollment_type", "number_of_arms",
    "start_date", "primary_completion_date", "completion_date", "duration_days",
    "has_results", "primary_outcome_measure", "primary_outcome_timeframe",
    "locations_count", "countries", "eligibility_min_age", "eligibility_max_age",
    "eligibility_gender", "outcome_success", "outcome_confidence",
)


TABLES = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double,"
    " props string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table, with its declared schema instead of a look into the files."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _names(values) -> Column:
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def _choice(value: str, pairs) -> Column:
    """CASE over the text of an SQL expression, as one expression."""
    branches = " ".join(f"WHEN '{source}' THEN '{target}'" for source, target in pairs)
    return F.expr(f"CASE {value} {branches} END")


def _bit(index: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), index.cast("int"))


def _members(mask: Column, names) -> Column:
    """Sorted names whose bit is set in ``mask``; an absent mask gives null.

    The list is put in order here, once, and not in every row.
    """
    bits, ordered = zip(*sorted(enumerate(names), key=lambda pair: pair[1].encode()))
    places = F.expr("array(" + ", ".join(map(str, bits)) + ")")
    kept = F.filter(_names(ordered), lambda x, i: F.getbit(mask, F.get(places, i)) == 1)
    return F.when(mask.isNotNull(), kept)


def _lines(spark: SparkSession, sf_dir: str, need_part: bool, need_supplier: bool) -> DataFrame:
    """Order lines folded to one row per order.

    Sets of conditions, types and countries travel as bit masks, suppliers as a
    set of keys, so an order with very many lines leaves each task as a single
    row. A distinct count would move all lines by order and supplier first, and
    then once more by order.
    """
    lines = table(spark, sf_dir, "lineitem")
    wanted = [
        F.count(F.lit(1)).alias("n_lines"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
        F.size(F.collect_set("l_suppkey")).alias("n_suppliers"),
    ]
    if need_part:
        # bits are made once per part, not once per line
        brand = F.substring("p_brand", 7, 4).cast("int") - 1
        kind = F.array_position(_names(t for t, _ in PART_INTERVENTIONS), F.col("p_type")) - 1
        part = table(spark, sf_dir, "part").select(
            "p_partkey", "p_name", "p_size",
            _bit(brand).alias("condition_bit"), _bit(kind).alias("type_bit"),
        )
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        wanted += [
            F.bit_or("condition_bit").alias("condition_mask"),
            F.bit_or("type_bit").alias("type_mask"),
            F.min("p_name").alias("first_name"),
            F.max("p_name").alias("last_name"),
            F.min("p_size").alias("min_size"),
            F.max("p_size").alias("max_size"),
        ]
    if need_supplier:
        supplier = table(spark, sf_dir, "supplier").select(
            "s_suppkey", _bit(F.col("s_nationkey")).alias("nation_bit")
        )
        lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        wanted.append(F.bit_or("nation_bit").alias("nation_mask"))
    return lines.groupBy("l_orderkey").agg(*wanted)


def trials(spark: SparkSession, sf_dir: str, columns=TRIAL_COLUMNS) -> DataFrame:
    """One trial per order, with the given columns."""
    return as_trials(spark, sf_dir, trial_parts(spark, sf_dir, columns), columns)


def trial_parts(spark: SparkSession, sf_dir: str, columns=TRIAL_COLUMNS) -> DataFrame:
    """``nct_id`` and what :func:`as_trials` makes the given columns from: half as wide as they are."""
    wanted = set(columns)
    orders = table(spark, sf_dir, "orders")
    df = orders
    if wanted & _CUSTOMER:
        customer = table(spark, sf_dir, "customer")
        df = df.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    if wanted & _LINES:
        folded = _lines(spark, sf_dir, bool(wanted & _PART), bool(wanted & _SUPPLIER))
        # the folded lines are partitioned by order already and grow with the
        # data: meet them there rather than broadcast them
        df = df.join(folded.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return df.withColumn("nct_id", F.expr("concat('NCT', format_string('%08d', o_orderkey))"))


def as_trials(spark: SparkSession, sf_dir: str, df: DataFrame, columns=TRIAL_COLUMNS) -> DataFrame:
    """The given trial columns, each row from its own parts alone."""
    wanted = set(columns)
    stage = {
        "overall_status": F.expr(
            """CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED'
                    WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'RECRUITING'
                    WHEN o_orderstatus = 'P' THEN 'COMPLETED'
                    WHEN o_orderkey % 4 = 0 THEN 'WITHDRAWN'
                    WHEN o_orderkey % 4 = 1 THEN 'SUSPENDED' ELSE 'TERMINATED' END"""
        ),
        "phase": _choice("substring(o_orderpriority, 1, 1)", PRIORITY_PHASES),
        "start_date": F.to_date("o_orderdate"),
        "enrollment": F.expr(
            "CASE WHEN o_orderkey % 17 <> 0 THEN cast(floor(o_totalprice / 80) as int) END"
        ),
        "study_type": F.lit("INTERVENTIONAL"),
        "eligibility_gender": F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'FEMALE' ELSE 'ALL' END"),
    }
    if wanted & _CUSTOMER:
        stage["sponsor_name"] = F.col("c_name")
        stage["sponsor_class"] = _choice("c_mktsegment", SEGMENT_CLASSES)
    if wanted & _LINES:
        stage["number_of_arms"] = F.col("n_lines").cast("int")
        stage["locations_count"] = F.col("n_suppliers").cast("int")
        stage["primary_completion_date"] = F.to_date("first_ship")
        stage["completion_date"] = F.to_date("last_ship")
    if wanted & _PART:
        stage["conditions"] = _members(F.col("condition_mask"), BRAND_CONDITIONS)
        stage["intervention_types"] = _members(F.col("type_mask"), [t for _, t in PART_INTERVENTIONS])
        stage["intervention_names"] = F.when(
            F.col("first_name").isNotNull(), F.array_distinct(F.array("first_name", "last_name"))
        )
        stage["eligibility_min_age"] = F.col("min_size")
        stage["eligibility_max_age"] = F.col("max_size")
    if wanted & _SUPPLIER:
        # 25 nations, so the list is one small scalar instead of a third join; it is in order of name, nulls last
        nations = (
            table(spark, sf_dir, "nation")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").isNull().alias("unnamed"), "n_name", "n_nationkey"))))
            .scalar()
        )
        df = df.withColumn("_nations", nations)
        kept = F.filter("_nations", lambda n: F.getbit(F.col("nation_mask"), n["n_nationkey"]) == 1)
        stage["countries"] = F.when(
            F.col("nation_mask").isNotNull(), F.transform(kept, lambda n: n["n_name"])
        )
    df = df.withColumns(stage)

    derived = {
        "has_results": F.expr("overall_status = 'COMPLETED' AND o_totalprice > 150000"),
        "outcome_success": labels.outcome_success(F.col("overall_status")),
        "enrollment_type": F.expr("if(overall_status = 'RECRUITING', 'ESTIMATED', 'ACTUAL')"),
    }
    if wanted & _LINES:
        derived["duration_days"] = F.when(
            F.col("completion_date").isNotNull(),
            F.greatest(F.lit(0), F.datediff("completion_date", "start_date")),
        )
    if wanted & _PART:
        derived["_conditions_text"] = joined_conditions(F.col("conditions"))
        derived["title"] = F.concat(
            F.lit("Study of "), F.coalesce("first_name", F.lit("unlisted agent")),
            F.lit(" "), F.coalesce("phase", F.lit("")),
        )
    df = df.withColumns(derived)

    last = {
        "outcome_confidence": labels.outcome_confidence(F.col("overall_status"), F.col("has_results"))
    }
    if wanted & _LINES:
        last["primary_outcome_timeframe"] = F.concat(F.col("duration_days").cast("string"), F.lit(" days"))
    if wanted & _PART:
        last["therapeutic_area"] = therapeutic_area("_conditions_text")
        last["brief_summary"] = F.concat(
            F.col("title"), F.lit(" in "), F.coalesce(F.array_join("conditions", ", "), F.lit(""))
        )
        last["primary_outcome_measure"] = F.concat(F.lit("Change after "), F.col("first_name"))
    return df.withColumns(last).select(*columns)


def _trial_number() -> Column:
    return F.expr("substring(nct_id, 4)").cast("long")


def raw_studies(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """Every trial as a nested registry document in the ``raw_json`` column.

    ``parts`` are those of :func:`trial_parts` where they have been moved
    already; its column ``page_number``, if any, is kept. Dates, ages, arms and the results marker come in all the shapes the
    normaliser has to accept, chosen by the trial number.
    """
    n = _trial_number()

    def date_text(column: str) -> Column:
        return (
            F.when(n % 3 == 0, F.date_format(column, "yyyy-MM-dd"))
            .when(n % 3 == 1, F.date_format(column, "MMMM yyyy"))
            .otherwise(F.date_format(column, "yyyy"))
        )

    def age_text(column: str) -> Column:
        years = F.col(column)
        return (
            F.when(n % 4 == 0, F.concat(years.cast("string"), F.lit(" Years")))
            .when(n % 4 == 1, F.concat((years * 12 + 5).cast("string"), F.lit(" Months")))
            .when(n % 4 == 2, F.concat((years * 52 + 3).cast("string"), F.lit(" Weeks")))
            .otherwise(years.cast("string"))
        )

    def struct(**fields: Column) -> Column:
        return F.struct(*[value.alias(name) for name, value in fields.items()])

    types = F.col("intervention_types")
    both = F.concat(types, types)
    countries = F.concat("countries", "countries")
    arm = F.transform(
        F.sequence(F.lit(1), F.col("number_of_arms")),
        lambda i: F.create_map(F.lit("label"), F.concat(F.lit("Arm "), i.cast("string"))),
    )
    results = F.create_map(F.lit("participants"), F.col("enrollment").cast("string"))
    document = struct(
        protocolSection=struct(
            identificationModule=struct(nctId=F.col("nct_id"), briefTitle=F.col("title")),
            statusModule=struct(
                overallStatus=F.col("overall_status"),
                startDateStruct=struct(date=date_text("start_date")),
                primaryCompletionDateStruct=struct(date=date_text("primary_completion_date")),
                completionDateStruct=struct(
                    date=F.when(n % 5 != 0, date_text("completion_date"))
                ),
            ),
            descriptionModule=struct(briefSummary=F.col("brief_summary")),
            designModule=struct(
                phases=F.when(F.col("phase").isNotNull(), F.array("phase", F.lit("PHASE4"))),
                studyType=F.col("study_type"),
                enrollmentInfo=struct(count=F.col("enrollment"), type=F.col("enrollment_type")),
                armGroups=F.when((n % 2 == 0) & F.col("number_of_arms").isNotNull(), arm),
                numberArms=F.when(n % 2 == 1, F.col("number_of_arms")),
            ),
            armsInterventionsModule=struct(
                interventions=F.transform(
                    both, lambda t: F.struct(t.alias("type"), F.concat(t, F.lit(" arm")).alias("name"))
                )
            ),
            conditionsModule=struct(conditions=F.col("conditions")),
            sponsorCollaboratorsModule=struct(
                leadSponsor=F.struct(
                    F.col("sponsor_name").alias("name"), F.col("sponsor_class").alias("class")
                )
            ),
            outcomesModule=struct(
                primaryOutcomes=F.array(
                    struct(
                        measure=F.col("primary_outcome_measure"),
                        timeFrame=F.col("primary_outcome_timeframe"),
                    ),
                    struct(measure=F.lit("second"), timeFrame=F.lit("later")),
                )
            ),
            eligibilityModule=struct(
                minimumAge=age_text("eligibility_min_age"),
                maximumAge=age_text("eligibility_max_age"),
                sex=F.when(F.col("eligibility_gender") != "ALL", F.col("eligibility_gender")),
            ),
            contactsLocationsModule=struct(
                locations=F.transform(countries, lambda c: F.struct(c.alias("country")))
            ),
        ),
        resultsSection=F.when(F.col("has_results") & (n % 2 == 0), results),
        hasResults=F.when(n % 2 == 1, F.col("has_results")),
    )
    parts = trial_parts(spark, sf_dir) if parts is None else parts
    kept = tuple(c for c in ("page_number",) if c in parts.columns)
    rows = as_trials(spark, sf_dir, parts, (*TRIAL_COLUMNS, *kept))
    return rows.select(F.to_json(document).alias("raw_json"), n.alias("number"), *kept)


def damaged_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw studies with two kinds of damage: withdrawn ones are cut off in the
    middle, suspended ones have words where the enrolment count belongs."""
    text = F.col("raw_json")
    cut = F.substring(text, F.lit(1), F.length(text) - 40)
    words = F.regexp_replace(text, r'"count":\d+', '"count":"many"')
    return raw_studies(spark, sf_dir).withColumn(
        "raw_json",
        F.when(F.contains(text, F.lit('"overallStatus":"WITHDRAWN"')), cut)
        .when(F.contains(text, F.lit('"overallStatus":"SUSPENDED"')), words)
        .otherwise(text),
    )


def study_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw studies packed into registry pages by trial number, 100 to a page.

    What the documents are made from is dealt out by page, and not the
    documents, which are several times as long.
    """
    parts = trial_parts(spark, sf_dir).withColumn("page_number", F.floor(_trial_number() / PAGE_SIZE))
    return pages_of(raw_studies(spark, sf_dir, parts.repartition("page_number")), F.col("page_number"))


INCOMING_COLUMNS = ("nct_id", "overall_status", "phase", "enrollment", "start_date", "outcome_success")


def incoming_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert batch: every running trial twice, as two later states, and every
    trial once more under a new number. ``revision`` orders the copies."""
    stored = trials(spark, sf_dir, INCOMING_COLUMNS)
    running = stored.filter(F.col("overall_status") == "RECRUITING").select(
        "*", F.explode(F.array(F.lit(1), F.lit(2))).alias("revision")
    )
    moved = running.withColumns(
        {
            "enrollment": F.coalesce("enrollment", F.lit(0)) + F.col("revision") * 1000,
            "overall_status": F.when(F.col("revision") == 2, "COMPLETED").otherwise("SUSPENDED"),
        }
    ).withColumn("outcome_success", labels.outcome_success(F.col("overall_status")))
    new = stored.withColumns(
        {
            "nct_id": F.concat(F.lit("NCT9"), F.expr("substring(nct_id, 4)")),
            "revision": F.lit(1),
        }
    )
    return moved.unionByName(new)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two model versions' scores of every labelled trial, by formula."""
    n = _trial_number()
    actual = F.col("outcome_success")
    hit = actual.cast("int")
    first = (F.lit(100) + 300 * hit + (n * 7919) % 500) / F.lit(1000.0)
    second = (F.lit(200) + 200 * hit + (n * 104729) % 600) / F.lit(1000.0)
    versions = F.array(
        F.struct(F.lit("v1").alias("model_version"), first.alias("predicted_proba")),
        F.struct(F.lit("v2").alias("model_version"), second.alias("predicted_proba")),
    )
    scored = (
        trials(spark, sf_dir, ("nct_id", "outcome_success"))
        .filter(actual.isNotNull())
        .select("nct_id", actual.alias("actual_label"), F.explode(versions).alias("_v"))
        .select("nct_id", "_v.*", "actual_label")
    )
    predicted = F.col("predicted_proba") >= 0.5
    return scored.withColumns(
        {"predicted_label": predicted, "correct": predicted == F.col("actual_label")}
    )


def metrics_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metrics table: one training run per model version and start year of trials."""
    starts = trials(spark, sf_dir, ("nct_id", "start_date"))
    scored = predictions(spark, sf_dir).join(starts, "nct_id")
    scored = scored.withColumn("trained_at", F.trunc("start_date", "year"))
    return overall_metrics(scored, ("model_version", "trained_at")).select(
        "model_version", "trained_at", "accuracy", "precision_score", "recall_score",
        "f1_score", "n_samples",
    )


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hypothetical trial design per part; the brand number decides gaps."""
    size = F.col("p_size")
    condition = F.get(_names(BRAND_CONDITIONS), F.substring("p_brand", 7, 4).cast("int") - 1)
    parts = table(spark, sf_dir, "part").withColumn("_condition", F.lower(condition))
    return parts.select(
        F.col("p_partkey").alias("design_id"),
        F.when(size <= 40, F.concat(F.lit("PHASE"), (size % 4 + 1).cast("string"))).alias("phase"),
        F.when(size % 3 == 0, "INDUSTRY").when(size % 3 == 1, "NIH").alias("sponsor_class"),
        F.when(size % 7 != 0, F.array(_choice("p_type", PART_INTERVENTIONS))).alias(
            "intervention_types"
        ),
        therapeutic_area("_condition").alias("therapeutic_area"),
        F.floor("p_retailprice").cast("int").alias("enrollment"),
        F.when(size % 5 != 0, size * 30).alias("duration_days"),
        F.when(size % 2 == 0, size % 4 + 1).alias("number_of_arms"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def incoming_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History batch: conversations with a system turn edited, every one also as new."""
    stored = messages(spark, sf_dir)
    prompted = stored.filter(F.col("role") == "system").select("conv_id").distinct()
    edited = stored.join(prompted, "conv_id", "left_semi").withColumn(
        "text", F.concat("text", F.lit(" (edited)"))
    )
    new = stored.withColumn("conv_id", F.col("conv_id") + 1_000_000_000)
    return edited.unionByName(new)


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History whose assistant turns are tool results: chart JSON, some of it
    without a type, some broken, with the calls that led there as ``tool_calls``."""
    size = F.length("text")
    kind = F.get(
        F.array(F.lit("success_rate_by_phase"), F.lit("sponsor_comparison"), F.lit("")),
        (size % 3).cast("int"),
    )
    body = F.concat(
        F.lit('{"chart_type":"'), kind, F.lit('","data":[{"name":"all","total":'),
        size.cast("string"), F.when(size % 7 == 0, "}").otherwise("}]}"),
    )
    calls = F.concat(
        F.lit('[{"name":"get_statistics","args":{"n":'), size.cast("string"),
        F.lit("}}"), F.when(size % 3 == 0, "").otherwise(',{"name":"generate_chart_data","args":{}}'),
        F.lit("]"),
    )
    assistant = F.col("role") == "assistant"
    return messages(spark, sf_dir).withColumns(
        {
            "tool_calls": F.when(assistant, calls),
            "text": F.when(assistant, body).otherwise(F.col("text")),
        }
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a request log; the event type stands for the service."""
    return table(spark, sf_dir, "events").select(
        "ts", "user_id", F.col("event_type").alias("service"), "value"
    )
