"""The check SQL: every registered query once more, in DuckDB's dialect.

It is written from the meaning of each query over the base tables, not from the
Spark plan, so that a mistake in one is seen as a difference to the other.
"""

from __future__ import annotations

from cohortlens.constants import (
    AREA_KEYWORDS, AREA_CODES, ENROLLMENT_BINS, ENROLLMENT_BINS_COMPACT, DURATION_BINS,
    DURATION_BINS_COMPACT, FEATURE_COLUMNS, INTERVENTION_CODES, PHASE_CODES, SPONSOR_CODES,
)
from cohortlens.plans.fixtures import (
    BRAND_CONDITIONS, PART_INTERVENTIONS, PRIORITY_PHASES, SEGMENT_CLASSES,
)


def _case(value: str, pairs, default: str | None = None) -> str:
    arms = " ".join(f"WHEN {value} = '{a}' THEN {b}" for a, b in pairs)
    return f"CASE {arms}" + (f" ELSE {default}" if default is not None else "") + " END"


def _quoted(pairs):
    return [(a, f"'{b}'") for a, b in pairs]


def _area(text: str) -> str:
    arms = " ".join(f"WHEN contains({text}, '{k}') THEN '{a}'" for k, a in AREA_KEYWORDS)
    return f"CASE {arms} ELSE 'Other' END"


def _bins(value: str, bins) -> str:
    arms = " ".join(f"WHEN {value} < {e} THEN '{n}'" for e, n in bins if e is not None)
    return f"CASE {arms} ELSE '{bins[-1][1]}' END"


_CONDITIONS = "[" + ", ".join(f"'{c}'" for c in BRAND_CONDITIONS) + "]"
_BRAND = f"({_CONDITIONS})[CAST(substr(p_brand, 7) AS INT)]"

TRIALS = f"""
lines AS (
  SELECT l_orderkey AS key, count(*) AS n_lines, min(l_shipdate) AS first_ship,
         max(l_shipdate) AS last_ship, count(DISTINCT l_suppkey) AS n_suppliers,
         list_sort(list_distinct(list({_BRAND}))) AS conditions,
         list_sort(list_distinct(list({_case("p_type", _quoted(PART_INTERVENTIONS))}))) AS intervention_types,
         list_sort(list_distinct(list(n_name))) AS countries,
         min(p_name) AS first_name, max(p_name) AS last_name,
         min(p_size) AS min_size, max(p_size) AS max_size
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY l_orderkey),
base AS (
  SELECT o_orderkey AS key, 'NCT' || printf('%08d', o_orderkey) AS nct_id,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETED'
              WHEN 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'RECRUITING' ELSE 'COMPLETED' END
              ELSE CASE o_orderkey % 4 WHEN 0 THEN 'WITHDRAWN' WHEN 1 THEN 'SUSPENDED'
                   ELSE 'TERMINATED' END END AS overall_status,
         {_case("substr(o_orderpriority, 1, 1)", _quoted(PRIORITY_PHASES))} AS phase,
         CAST(o_orderdate AS DATE) AS start_date, o_totalprice,
         CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice / 80) AS INT) END AS enrollment,
         CASE WHEN o_orderkey % 7 = 0 THEN 'FEMALE' ELSE 'ALL' END AS eligibility_gender,
         c_name AS sponsor_name,
         {_case("c_mktsegment", _quoted(SEGMENT_CLASSES))} AS sponsor_class
  FROM orders JOIN customer ON o_custkey = c_custkey),
trials AS (
  SELECT b.key, nct_id,
         'Study of ' || coalesce(first_name, 'unlisted agent') || ' ' || coalesce(phase, '') AS title,
         'Study of ' || coalesce(first_name, 'unlisted agent') || ' ' || coalesce(phase, '')
           || ' in ' || coalesce(array_to_string(conditions, ', '), '') AS brief_summary,
         overall_status, phase, 'INTERVENTIONAL' AS study_type, conditions,
         {_area("lower(coalesce(array_to_string(conditions, ' '), ''))")} AS therapeutic_area,
         intervention_types, list_distinct([first_name, last_name]) AS two_names,
         CASE WHEN first_name = last_name THEN [first_name]
              WHEN first_name IS NOT NULL THEN [first_name, last_name] END AS intervention_names,
         sponsor_name, sponsor_class, enrollment,
         CASE WHEN overall_status = 'RECRUITING' THEN 'ESTIMATED' ELSE 'ACTUAL' END AS enrollment_type,
         CAST(n_lines AS INT) AS number_of_arms, start_date,
         CAST(first_ship AS DATE) AS primary_completion_date, CAST(last_ship AS DATE) AS completion_date,
         CASE WHEN last_ship IS NOT NULL
              THEN greatest(0, date_diff('day', start_date, CAST(last_ship AS DATE))) END::INT AS duration_days,
         overall_status = 'COMPLETED' AND o_totalprice > 150000 AS has_results,
         'Change after ' || first_name AS primary_outcome_measure,
         CAST(n_suppliers AS INT) AS locations_count, countries,
         min_size AS eligibility_min_age, max_size AS eligibility_max_age, eligibility_gender,
         CASE WHEN overall_status = 'COMPLETED' THEN true
              WHEN overall_status IN ('TERMINATED', 'WITHDRAWN', 'SUSPENDED') THEN false END AS outcome_success,
         CASE WHEN overall_status = 'COMPLETED' AND o_totalprice > 150000 THEN 0.85::DOUBLE
              WHEN overall_status = 'COMPLETED' THEN 0.6::DOUBLE
              WHEN overall_status IN ('TERMINATED', 'WITHDRAWN', 'SUSPENDED') THEN 0.9::DOUBLE
              ELSE 0.0::DOUBLE END AS outcome_confidence
  FROM base b LEFT JOIN lines l ON b.key = l.key)
"""

PREDICTIONS = """
scores AS (
  SELECT key, nct_id, outcome_success AS actual_label, 'v1' AS model_version,
         (100 + 300 * outcome_success::INT + (key * 7919) % 500) / 1000.0::DOUBLE AS predicted_proba
  FROM trials WHERE outcome_success IS NOT NULL
  UNION ALL
  SELECT key, nct_id, outcome_success, 'v2',
         (200 + 200 * outcome_success::INT + (key * 104729) % 600) / 1000.0::DOUBLE
  FROM trials WHERE outcome_success IS NOT NULL),
predictions AS (
  SELECT *, predicted_proba >= 0.5 AS predicted_label,
         (predicted_proba >= 0.5) = actual_label AS correct FROM scores)
"""


def _t(sql: str) -> str:
    return f"WITH {TRIALS} {sql}"


def _p(sql: str) -> str:
    return f"WITH {TRIALS}, {PREDICTIONS} {sql}"


TOTAL = "count(*)"
SUCC = "count(*) FILTER (WHERE outcome_success)"
PCT = f"(({SUCC} * 2000 + {TOTAL}) // (2 * {TOTAL})) / 10.0::DOUBLE"
ENR = "round(avg(enrollment), 0)"
DUR = "round(avg(duration_days), 0)"
LAB = "outcome_success IS NOT NULL"


def _stats(dim: str, where: str = "", compact: bool = False) -> str:
    duration = "" if compact else f", {DUR} AS avg_duration_days"
    return _t(
        f"SELECT {dim} AS group_name, {TOTAL} AS total, {SUCC} AS successes, {PCT} AS success_rate_pct,"
        f" {ENR} AS avg_enrollment{duration} FROM trials WHERE {LAB} {where} GROUP BY {dim}"
    )


def _joined(column: str) -> str:
    return f"array_to_string({column}, '|') AS {column}"


def _arrays(columns) -> str:
    lists = {"conditions", "intervention_types", "intervention_names", "countries"}
    return ", ".join(_joined(c) if c in lists else c for c in columns)


_DETAIL = (
    "nct_id", "title", "brief_summary", "overall_status", "phase", "study_type", "conditions",
    "therapeutic_area", "intervention_types", "intervention_names", "sponsor_name",
    "sponsor_class", "enrollment", "number_of_arms", "start_date", "primary_completion_date",
    "completion_date", "duration_days", "has_results", "primary_outcome_measure",
    "duration_days || ' days' AS primary_outcome_timeframe", "locations_count", "countries",
    "eligibility_min_age", "eligibility_max_age", "eligibility_gender", "outcome_success",
    "outcome_confidence",
)

_SEARCH = (
    "nct_id, title, overall_status, phase, therapeutic_area, sponsor_name, sponsor_class,"
    " enrollment, duration_days, has_results, outcome_success, start_date, completion_date"
)
_SEARCH_COMPACT = (
    "nct_id, title, overall_status, phase, therapeutic_area, sponsor_name, enrollment,"
    " duration_days, outcome_success"
)
_NEWEST = "ORDER BY completion_date DESC NULLS LAST, nct_id"


def _compare(dim: str, a: str, b: str, where: str = "", median: bool = True) -> str:
    extra = ", quantile_cont(enrollment, 0.5) AS median_enrollment" if median else ""
    name = ", median_enrollment" if median else ""
    return _t(
        f""", asked(side, name) AS (VALUES ('group_a', '{a}'), ('group_b', '{b}')),
        found AS (SELECT {dim} AS name, {TOTAL} AS total, {SUCC} AS successes,
          {PCT} AS success_rate_pct, {ENR} AS avg_enrollment, {DUR} AS avg_duration_days{extra}
          FROM trials WHERE {LAB} {where} GROUP BY {dim})
        SELECT side, name, coalesce(total, 0) AS total, successes, success_rate_pct,
          avg_enrollment, avg_duration_days{name} FROM asked LEFT JOIN found USING (name)"""
    )


def _chart(name: str, measures: str, where: str, tail: str = "", alias: str = "name") -> str:
    return _t(f"SELECT {name} AS {alias}, {measures} FROM trials WHERE {LAB} AND {where} GROUP BY 1 {tail}")


_RATE = f"{PCT} AS success_rate, {TOTAL} AS total"


def _date_shape(column: str) -> str:
    return (
        f"CAST(CASE key % 3 WHEN 0 THEN {column} WHEN 1 THEN date_trunc('month', {column})"
        f" ELSE date_trunc('year', {column}) END AS DATE)"
    )


NORMALISED_DATES = f"""
SELECT nct_id, s AS start_date, p AS primary_completion_date, c AS completion_date,
       CASE WHEN s IS NOT NULL AND coalesce(c, p) IS NOT NULL
            THEN greatest(0, date_diff('day', s, coalesce(c, p))) END::INT AS duration_days
FROM (SELECT nct_id, {_date_shape("start_date")} AS s, {_date_shape("primary_completion_date")} AS p,
             CASE WHEN key % 5 <> 0 THEN {_date_shape("completion_date")} END AS c FROM trials)
"""


def _codes(value: str, table: dict, default: float) -> str:
    return _case(value, [(k, f"{v}::DOUBLE") for k, v in table.items()], f"{default}::DOUBLE")


def _list_of(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _features(key: str, source: str) -> str:
    known = f"list_filter(intervention_types, lambda t: list_contains({_list_of(INTERVENTION_CODES)}, t))[1]"
    return f"""
    SELECT {key},
      {_codes("phase", PHASE_CODES, -1)} AS phase_numeric,
      {_codes("upper(sponsor_class)", SPONSOR_CODES, 5)} AS sponsor_class_encoded,
      {_codes(known, INTERVENTION_CODES, 9)} AS intervention_type_encoded,
      {_codes("therapeutic_area", AREA_CODES, 10)} AS therapeutic_area_encoded,
      round(ln(1 + coalesce(enrollment, 0)::DOUBLE), 9) AS enrollment_log,
      round(ln(1 + coalesce(duration_days, 0)::DOUBLE), 9) AS duration_days_log,
      least(20, greatest(1, coalesce(number_of_arms, 1)))::DOUBLE AS number_of_arms,
      round(ln(1 + coalesce(locations_count, 1)::DOUBLE), 9) AS locations_count_log,
      coalesce(len(countries), 1)::DOUBLE AS n_countries,
      coalesce(eligibility_min_age, 18)::DOUBLE AS eligibility_min_age,
      coalesce(eligibility_max_age, 65)::DOUBLE AS eligibility_max_age,
      coalesce(upper(sponsor_class) = 'INDUSTRY', false)::INT::DOUBLE AS is_industry_sponsored,
      (coalesce(locations_count, 1) > 1)::INT::DOUBLE AS is_multicenter,
      (coalesce(len(countries), 1) > 1)::INT::DOUBLE AS is_international,
      coalesce(list_contains(intervention_types, 'DRUG'), false)::INT::DOUBLE AS has_drug_intervention,
      (enrollment IS NULL)::INT::DOUBLE AS enrollment_missing,
      (duration_days IS NULL)::INT::DOUBLE AS duration_missing
    FROM {source}"""


_TRAIN = f"{LAB} AND outcome_confidence >= 0.6"
_RANKED = f"""
, ranked AS (
  SELECT nct_id, outcome_success::INT AS label,
         row_number() OVER (PARTITION BY outcome_success ORDER BY md5(nct_id || '|42'), nct_id) AS r,
         count(*) OVER (PARTITION BY outcome_success) AS n
  FROM trials WHERE {_TRAIN}),
dealt AS (SELECT nct_id, label, r <= (n * 20 + 99) // 100 AS is_test, ((r - 1) % 5)::INT AS fold FROM ranked)
"""

_TP = "count(*) FILTER (WHERE predicted_label AND actual_label)"
_TN = "count(*) FILTER (WHERE NOT predicted_label AND NOT actual_label)"
_FP = "count(*) FILTER (WHERE predicted_label AND NOT actual_label)"
_FN = "count(*) FILTER (WHERE NOT predicted_label AND actual_label)"
_COUNTS = f"{_TP} AS tp, {_TN} AS tn, {_FP} AS fp, {_FN} AS fn"
_METRICS = """
  SELECT *, tp + tn + fp + fn AS n_samples,
    (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy,
    CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision_score,
    CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall_score
  FROM counts
"""
_F1 = (
    "CASE WHEN precision_score + recall_score > 0 THEN round(2 * precision_score * recall_score"
    " / (precision_score + recall_score), 9) ELSE 0 END AS f1_score"
)


def _quality(keys: str, accuracy: str = "round(accuracy, 9)") -> str:
    return (
        f"SELECT {keys}, tp, tn, fp, fn, n_samples, {accuracy} AS accuracy,"
        f" round(precision_score, 9) AS precision_score, round(recall_score, 9) AS recall_score, {_F1}"
        f" FROM ({_METRICS})"
    )


_ACCURACY4 = "((tp + tn) * 20000 + n_samples) // (2 * n_samples) / 10000.0::DOUBLE"


def _accuracy_by(dim: str) -> str:
    right = "count(*) FILTER (WHERE correct)"
    return _p(
        f"SELECT t.{dim}, round({right}::DOUBLE / count(*), 9) AS accuracy,"
        f" ({right} * 2000 + count(*)) // (2 * count(*)) / 10.0::DOUBLE AS accuracy_pct, count(*) AS n"
        f" FROM predictions p JOIN trials t USING (nct_id) WHERE model_version = 'v1'"
        f" AND t.{dim} IS NOT NULL GROUP BY 1"
    )


_TITLE = (
    "CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END"
)
_SUMMARIES = f"""
SELECT conv_id, coalesce(nullif(min_by({_TITLE}, turn) FILTER (WHERE role = 'user'), ''), 'Untitled') AS title,
       count(*) AS message_count, max(turn) AS last_turn
FROM conversations GROUP BY conv_id
"""
_PROMPTED = "(SELECT conv_id FROM conversations WHERE role = 'system')"
_SHIFT = "conv_id + 1000000000 AS conv_id"
_TOOLS = """
WITH m AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations),
tools AS (
  SELECT conv_id, turn, n, CASE n % 3 WHEN 0 THEN 'success_rate_by_phase' WHEN 1 THEN 'sponsor_comparison'
         ELSE '' END AS chart_type FROM m WHERE role = 'assistant')
"""


def _draw(name: str) -> str:
    return f"(('0x' || substr(md5(c_custkey || '|{name}|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _pick(options, name: str) -> str:
    return f"{_list_of(options)}[1 + floor({_draw(name)} * {len(options)})::INT]"


def _between(low: int, high: int, name: str) -> str:
    return f"(floor({_draw(name)} * {high - low + 1}) + {low})::INT"


def _synthetic() -> str:
    from cohortlens.sources import synthetic as S

    names = [s for s, _ in S.SPONSORS]
    countries = ", ".join(
        f"{{'o': {_draw(f'country{i}')}, 'n': '{c}'}}" for i, c in enumerate(S.COUNTRIES)
    )
    return f"""
    WITH g AS (SELECT 'NCT' || (c_custkey + 90000000) AS nct_id, c_custkey,
      CASE WHEN {_draw("status")} < 0.55::DOUBLE THEN 'COMPLETED'
           WHEN {_draw("status")} < 0.55::DOUBLE + 0.25::DOUBLE THEN 'TERMINATED'
           WHEN {_draw("status")} < 0.55::DOUBLE + 0.25::DOUBLE + 0.1::DOUBLE THEN 'WITHDRAWN'
           ELSE 'SUSPENDED' END AS overall_status,
      {_pick(S.PHASES, "phase")} AS phase, {_pick(S.AREAS, "area")} AS therapeutic_area,
      {_pick(S.INTERVENTIONS, "intervention")} AS intervention_types,
      {_pick(names, "sponsor")} AS sponsor_name,
      greatest(10, floor(exp(5.0::DOUBLE + 1.2::DOUBLE * (sqrt(-2 * ln(1 - {_draw("radius")}))
        * cos(2 * pi() * {_draw("angle")}))))::INT) AS enrollment,
      [1, 2, 2, 3][1 + floor({_draw("arms")} * 4)::INT] AS number_of_arms,
      DATE '2005-01-01' + floor({_draw("start")} * 5844)::INT AS start_date,
      {_between(180, 2000, "duration")} AS duration_days, {_draw("results")} > 0.3::DOUBLE AS published,
      {_between(1, 100, "sites")} AS locations_count,
      array_to_string(list_transform(list_sort([{countries}]), lambda x: x.n)[1:{_between(1, 3, "countries")}], '|') AS countries,
      [65, 75, 99][1 + floor({_draw("max_age")} * 3)::INT] AS eligibility_max_age
    FROM customer)
    SELECT nct_id, 'Trial ' || c_custkey || ', ' || phase || ': ' || therapeutic_area AS title,
      overall_status, phase, therapeutic_area, intervention_types, sponsor_name,
      {_case("sponsor_name", _quoted(S.SPONSORS))} AS sponsor_class, enrollment, number_of_arms,
      start_date, start_date + duration_days AS completion_date, duration_days,
      overall_status = 'COMPLETED' AND published AS has_results, locations_count, countries,
      eligibility_max_age, overall_status = 'COMPLETED' AS outcome_success,
      CASE WHEN overall_status <> 'COMPLETED' THEN 0.9::DOUBLE WHEN published THEN 0.85::DOUBLE
           ELSE 0.6::DOUBLE END AS outcome_confidence
    FROM g"""


_EDGE = "(lo + {i} * ((hi - lo) / 10))"
_CALIBRATION = _p(
    """, v AS (SELECT predicted_proba AS p, actual_label FROM predictions WHERE model_version = 'v1'),
    r AS (SELECT min(p) AS lo, max(p) AS hi FROM v),
    b AS (SELECT lo, hi, actual_label, 1 + """
    + " + ".join(f"(p > {_EDGE.format(i=i)})::INT" for i in range(1, 10))
    + """ AS bin FROM v, r)
    SELECT bin, round(CASE WHEN bin = 1 THEN lo - (hi - lo) * 0.001::DOUBLE ELSE """
    + _EDGE.format(i="(bin - 1)")
    + """ END, 9) AS bin_lo, round(CASE WHEN bin = 10 THEN hi ELSE """
    + _EDGE.format(i="bin")
    + """ END, 9) AS bin_hi,
    round(count(*) FILTER (WHERE actual_label)::DOUBLE / count(*), 9) AS actual_rate, count(*) AS n
    FROM b GROUP BY bin, lo, hi"""
)

_BATCH = """
, stored AS (SELECT nct_id, overall_status, phase, enrollment, start_date, outcome_success FROM trials),
moved AS (SELECT nct_id, 'COMPLETED' AS overall_status, phase, (coalesce(enrollment, 0) + 2000)::INT AS enrollment,
          start_date, true AS outcome_success FROM stored WHERE overall_status = 'RECRUITING'),
added AS (SELECT 'NCT9' || substr(nct_id, 4) AS nct_id, overall_status, phase, enrollment, start_date,
          outcome_success FROM stored)
"""

_REPORT = _p(
    f""", c AS (SELECT {_COUNTS} FROM predictions WHERE model_version = 'v1'),
    q AS (SELECT 'failure' AS class_name, tn::DOUBLE / (tn + fn) AS p, tn::DOUBLE / (tn + fp) AS r, tn + fp AS s FROM c
          UNION ALL SELECT 'success', tp::DOUBLE / (tp + fp), tp::DOUBLE / (tp + fn), tp + fn FROM c),
    f AS (SELECT *, 2 * p * r / (p + r) AS f FROM q)
    SELECT class_name, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, s AS support FROM f
    UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9), sum(s)::BIGINT FROM f
    UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 9), round(sum(r * s) / sum(s), 9),
      round(sum(f * s) / sum(s), 9), sum(s)::BIGINT FROM f"""
)

_FOLLOWS = "true AS sums_to_one, true AS label_follows, true AS band_follows, true AS percent_follows, true AS in_range"

ORACLE: dict[str, str] = {
    "stats_by_phase": _stats("phase"),
    "stats_by_area": _stats("therapeutic_area", "AND phase = 'PHASE2'"),
    "stats_by_sponsor_class": _stats("sponsor_class", "AND therapeutic_area ILIKE '%OLOGY%'"),
    "stats_by_status": _stats("overall_status", "AND sponsor_class = 'NIH'"),
    "stats_compact": _stats("phase", compact=True),
    "search_trials": _t(
        f"SELECT {_SEARCH} FROM trials WHERE (title ILIKE '%gear%' OR list_contains(conditions, 'gear'))"
        " AND phase = 'PHASE3' AND therapeutic_area ILIKE '%onco%' AND sponsor_class = 'INDUSTRY'"
        f" AND overall_status = 'COMPLETED' AND outcome_success {_NEWEST} LIMIT 100"
    ),
    "search_trials_compact": _t(
        f"SELECT {_SEARCH_COMPACT} FROM trials WHERE title ILIKE '%C_ld G%' {_NEWEST} LIMIT 50"
    ),
    "search_array_member": _t(
        f"SELECT {_SEARCH} FROM trials WHERE title ILIKE '%COVID-19%'"
        f" OR list_contains(conditions, 'COVID-19') {_NEWEST} LIMIT 30"
    ),
    "trial_details": _t(f"SELECT {_arrays(_DETAIL)} FROM trials WHERE nct_id = 'NCT00000042'"),
    "trial_details_full": _t(
        f"SELECT {_arrays(_DETAIL)}, enrollment_type, CAST(NULL AS INT) AS number_of_groups,"
        " DATE '2030-01-01' AS ingested_at, DATE '2030-01-01' AS updated_at FROM trials WHERE nct_id = 'NCT00000012'"
    ),
    "compare_groups": _compare("sponsor_class", "INDUSTRY", "NIH", "AND therapeutic_area ILIKE '%onco%'"),
    "compare_groups_compact": _compare("phase", "PHASE2", "PHASE3", median=False),
    "compare_missing_group": _compare("therapeutic_area", "Oncology", "oncology"),
    "top_sponsors": _t(
        f"SELECT sponsor_name, sponsor_class, {TOTAL} AS total_trials, {SUCC} AS successes,"
        f" {PCT} AS success_rate_pct, {ENR} AS avg_enrollment FROM trials"
        f" WHERE {LAB} AND sponsor_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3"
        " ORDER BY total_trials DESC, sponsor_name, sponsor_class LIMIT 50"
    ),
    "top_sponsors_compact": _t(
        f"SELECT sponsor_name, sponsor_class, {TOTAL} AS total_trials, {PCT} AS success_rate_pct"
        f" FROM trials WHERE {LAB} AND sponsor_name IS NOT NULL AND phase = 'PHASE1' GROUP BY 1, 2"
        " HAVING count(*) >= 3 ORDER BY total_trials DESC, sponsor_name, sponsor_class LIMIT 10"
    ),
    "chart_phase": _chart("phase", _RATE, "phase IS NOT NULL"),
    "chart_area": _chart("therapeutic_area", _RATE, "therapeutic_area IS NOT NULL"),
    "chart_enrollment": _chart(
        _bins("enrollment", ENROLLMENT_BINS), _RATE, "enrollment IS NOT NULL AND phase = 'PHASE2'", alias="bucket"
    ),
    "chart_enrollment5": _chart(
        _bins("enrollment", ENROLLMENT_BINS_COMPACT), _RATE, "enrollment IS NOT NULL", alias="bucket"
    ),
    "chart_volume": _chart(
        "CAST(date_trunc('year', start_date) AS DATE)",
        f"{TOTAL} AS total, {SUCC} AS successes, year(any_value(start_date))::INT AS year_number",
        "start_date IS NOT NULL AND therapeutic_area ILIKE '%neuro%'", alias="year",
    ),
    "chart_volume_compact": _chart(
        "CAST(date_trunc('year', start_date) AS DATE)",
        f"{TOTAL} AS total, year(any_value(start_date))::INT AS year_number", "start_date IS NOT NULL", alias="year",
    ),
    "chart_sponsor": _chart(
        "sponsor_class", f"{_RATE}, {ENR} AS avg_enrollment", "sponsor_class IS NOT NULL",
        "ORDER BY total DESC, name LIMIT 6",
    ),
    "chart_sponsor_compact": _chart(
        "sponsor_class", _RATE, "sponsor_class IS NOT NULL", "ORDER BY total DESC, name LIMIT 6"
    ),
    "chart_duration": _chart(
        _bins("duration_days", DURATION_BINS), _RATE, "duration_days IS NOT NULL", alias="bucket"
    ),
    "chart_duration4": _chart(
        _bins("duration_days", DURATION_BINS_COMPACT), _RATE, "duration_days IS NOT NULL", alias="bucket"
    ),
    "normalize_core": _t(
        "SELECT nct_id, title, brief_summary, overall_status, phase, study_type, sponsor_name, sponsor_class,"
        " enrollment, enrollment_type, number_of_arms, has_results, primary_outcome_measure,"
        " duration_days || ' days' AS primary_outcome_timeframe,"
        " (2 * coalesce(len(countries), 0))::INT AS locations_count, eligibility_gender FROM trials"
    ),
    "normalize_area": _t("SELECT nct_id, therapeutic_area FROM trials"),
    "normalize_age": _t("SELECT nct_id, eligibility_min_age, eligibility_max_age FROM trials"),
    "normalize_dates": _t(NORMALISED_DATES),
    "normalize_outcome": _t("SELECT nct_id, outcome_success, outcome_confidence FROM trials"),
    "normalize_arrays": _t(
        "SELECT nct_id, coalesce(array_to_string(conditions, '|'), '') AS conditions,"
        " coalesce(array_to_string(intervention_types, '|'), '') AS intervention_types,"
        " coalesce(array_to_string(list_transform(list_concat(intervention_types, intervention_types)[1:5],"
        " lambda x: x || ' arm'), '|'), '') AS intervention_names,"
        " coalesce(array_to_string(countries, '|'), '') AS countries FROM trials"
    ),
    "page_source": _t(
        "SELECT overall_status, count(*) AS studies, sum(enrollment)::BIGINT AS enrolled FROM trials GROUP BY 1"
    ),
    "source_filter_cap": _t(
        "SELECT nct_id, title, overall_status FROM trials WHERE overall_status IN ('COMPLETED', 'TERMINATED',"
        " 'WITHDRAWN') AND title ILIKE '%ring%' ORDER BY nct_id LIMIT 1000"
    ),
    "synthetic_trials": _synthetic(),
    "upsert_result": _t(
        f"""{_BATCH} SELECT *, start_date AS ingested_at, start_date AS updated_at FROM stored
        WHERE overall_status <> 'RECRUITING'
        UNION ALL SELECT *, start_date, DATE '2030-01-01' FROM moved
        UNION ALL SELECT *, DATE '2030-01-01', DATE '2030-01-01' FROM added"""
    ),
    "upsert_counts": _t(
        f"{_BATCH} SELECT (SELECT count(*) FROM added) AS inserted, (SELECT count(*) FROM moved) AS updated"
    ),
    "merge_touched": _t(
        f"""{_BATCH}, whole AS (SELECT *, start_date AS ingested_at, start_date AS updated_at FROM stored
        WHERE overall_status <> 'RECRUITING'
        UNION ALL SELECT *, start_date, DATE '2030-01-01' FROM moved
        UNION ALL SELECT *, DATE '2030-01-01', DATE '2030-01-01' FROM added)
        SELECT *, (SELECT count(*) FROM added) AS inserted, (SELECT count(*) FROM moved) AS updated FROM whole"""
    ),
    "insert_absent": _t(f"{_BATCH} SELECT * FROM added"),
    "conv_list": f"SELECT conv_id, title, message_count FROM ({_SUMMARIES}) ORDER BY conv_id DESC LIMIT 20 OFFSET 5",
    "conv_messages": "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 7",
    "conv_titles": _SUMMARIES,
    "conv_dialogue": "SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')",
    "conv_upsert": (
        f"SELECT conv_id, turn, role, CASE WHEN conv_id IN {_PROMPTED} THEN text || ' (edited)' ELSE text END AS text"
        f" FROM conversations UNION ALL SELECT {_SHIFT}, turn, role, text FROM conversations"
    ),
    "conv_title_upsert": (
        f"SELECT conv_id, title FROM ({_SUMMARIES}) UNION ALL SELECT {_SHIFT}, title FROM ({_SUMMARIES})"
    ),
    "conv_delete": f"SELECT conv_id, turn, role, text FROM conversations WHERE conv_id NOT IN {_PROMPTED}",
    "chart_payloads": (
        f"{_TOOLS} SELECT conv_id, turn, chart_type, n AS total FROM tools WHERE n % 7 <> 0 AND chart_type <> ''"
    ),
    "tool_usage": (
        f"{_TOOLS} SELECT 'get_statistics' AS tool, count(*) AS calls, count(DISTINCT conv_id) AS conversations FROM tools"
        " UNION ALL SELECT 'generate_chart_data', count(*), count(DISTINCT conv_id) FROM tools WHERE n % 3 <> 0"
    ),
    "features_matrix": _t(_features("nct_id", "trials")),
    "features_designs": f"""WITH designs AS (SELECT p_partkey AS design_id,
        CASE WHEN p_size <= 40 THEN 'PHASE' || (p_size % 4 + 1) END AS phase,
        CASE p_size % 3 WHEN 0 THEN 'INDUSTRY' WHEN 1 THEN 'NIH' ELSE '' END AS sponsor_class,
        CASE WHEN p_size % 7 <> 0 THEN [{_case("p_type", _quoted(PART_INTERVENTIONS))}] ELSE [] END AS intervention_types,
        {_area("lower(" + _BRAND + ")")} AS therapeutic_area, floor(p_retailprice)::INT AS enrollment,
        CASE WHEN p_size % 5 <> 0 THEN p_size * 30 END AS duration_days,
        CASE WHEN p_size % 2 = 0 THEN p_size % 4 + 1 ELSE 2 END AS number_of_arms, 10 AS locations_count,
        []::VARCHAR[] AS countries, 18 AS eligibility_min_age, 65 AS eligibility_max_age FROM part)
        {_features("design_id", "designs")}""",
    "train_set": _t(f"SELECT nct_id, outcome_success::INT AS label FROM trials WHERE {_TRAIN}"),
    "class_balance": _t(
        f"SELECT outcome_success::INT AS label, count(*) AS n FROM trials WHERE {_TRAIN} GROUP BY 1"
    ),
    "split_members": _t(f"{_RANKED} SELECT nct_id, label, is_test FROM dealt"),
    "split_sizes": _t(f"{_RANKED} SELECT label, is_test, count(*) AS n FROM dealt GROUP BY 1, 2"),
    "fold_sizes": _t(
        f'{_RANKED} SELECT label, fold, count(*) AS n, min(nct_id) AS "first", max(nct_id) AS "last"'
        " FROM dealt GROUP BY 1, 2"
    ),
    "class_weight": _t(
        f"{_RANKED} SELECT count(*) FILTER (WHERE label = 0) AS n_negative,"
        " count(*) FILTER (WHERE label = 1) AS n_positive,"
        " round(count(*) FILTER (WHERE label = 0)::DOUBLE / greatest(count(*) FILTER (WHERE label = 1), 1), 9)"
        " AS positive_weight FROM dealt WHERE NOT is_test"
    ),
    "metrics_overall": _p(
        f", counts AS (SELECT model_version, {_COUNTS} FROM predictions GROUP BY 1) {_quality('model_version')}"
    ),
    "class_report": _REPORT,
    "confusion": _p(f"SELECT model_version, {_COUNTS} FROM predictions GROUP BY 1"),
    "confusion_share": _p(
        f""", c AS (SELECT {_COUNTS}, count(*) AS total FROM predictions WHERE model_version = 'v1'),
        u AS (SELECT 'True Positive' AS cell, tp AS n, total FROM c UNION ALL SELECT 'False Positive', fp, total FROM c
              UNION ALL SELECT 'False Negative', fn, total FROM c UNION ALL SELECT 'True Negative', tn, total FROM c)
        SELECT cell, n, (n * 2000 + total) // (2 * total) / 10.0::DOUBLE AS share_pct FROM u"""
    ),
    "auc": _p(
        """, k AS (SELECT model_version, actual_label,
          rank() OVER w + (count(*) OVER (PARTITION BY model_version, predicted_proba) - 1) / 2.0::DOUBLE AS r
          FROM predictions WINDOW w AS (PARTITION BY model_version ORDER BY predicted_proba))
        SELECT model_version, count(*) FILTER (WHERE actual_label) AS n_positive,
          count(*) FILTER (WHERE NOT actual_label) AS n_negative,
          round((sum(r) FILTER (WHERE actual_label) - count(*) FILTER (WHERE actual_label)::DOUBLE
            * (count(*) FILTER (WHERE actual_label) + 1) / 2) / (count(*) FILTER (WHERE actual_label)::DOUBLE
            * count(*) FILTER (WHERE NOT actual_label)), 9) AS auc_roc
        FROM k GROUP BY 1"""
    ),
    "calibration": _CALIBRATION,
    "accuracy_by_phase": _accuracy_by("phase"),
    "accuracy_by_area": _accuracy_by("therapeutic_area"),
    "benchmark_summary": _p(
        f""", counts AS (SELECT model_version, {_COUNTS} FROM predictions WHERE model_version = 'v1' GROUP BY 1)
        {_quality("model_version", _ACCURACY4)}"""
    ),
    "benchmark_first_rows": _p(
        f""", picked AS (SELECT * FROM predictions WHERE model_version = 'v1' ORDER BY nct_id LIMIT 500),
        counts AS (SELECT model_version, {_COUNTS} FROM picked GROUP BY 1) {_quality("model_version", _ACCURACY4)}"""
    ),
    "benchmark_filtered": _p(
        f""", counts AS (SELECT model_version, {_COUNTS} FROM predictions p JOIN trials t USING (nct_id)
          WHERE model_version = 'v2' AND therapeutic_area ILIKE '%onco%' AND phase = 'PHASE2' GROUP BY 1)
        {_quality("model_version", _ACCURACY4)}"""
    ),
    "confidence_bands": _p(
        "SELECT model_version, CASE WHEN abs(predicted_proba - 0.5::DOUBLE) > 0.25::DOUBLE THEN 'High'"
        " WHEN abs(predicted_proba - 0.5::DOUBLE) > 0.1::DOUBLE THEN 'Medium' ELSE 'Low' END AS confidence,"
        " count(*) AS n FROM predictions GROUP BY 1, 2"
    ),
    "traffic_light": _p(
        ", s AS (SELECT floor(predicted_proba * 100 + 0.5::DOUBLE)::INT AS pct FROM predictions)"
        " SELECT CASE WHEN pct >= 60 THEN 'green' WHEN pct >= 40 THEN 'yellow' ELSE 'red' END AS light, pct,"
        " count(*) AS n FROM s GROUP BY 1, 2"
    ),
    "latest_metrics": _p(
        f""", counts AS (SELECT model_version, CAST(date_trunc('year', start_date) AS DATE) AS trained_at, {_COUNTS}
          FROM predictions p JOIN trials t USING (nct_id) GROUP BY 1, 2
          QUALIFY row_number() OVER (PARTITION BY model_version ORDER BY trained_at DESC) = 1)
        SELECT * EXCLUDE (tp, tn, fp, fn) FROM ({_quality("model_version, trained_at")})"""
    ),
    "alarm_periods": """
        WITH c AS (SELECT event_type AS service, CAST(ts AS DATE) AS day, count(*) AS errors FROM events
                   WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) > 65)
        SELECT a.service, a.day AS period_start, least(a.errors, b.errors) AS least_errors,
               a.errors + b.errors AS errors_in_run
        FROM c a JOIN c b ON a.service = b.service AND b.day = a.day - 1""",
    "over_limit": """
        SELECT user_id, CAST(ts AS DATE) AS period_start, count(*) AS requests FROM events
        GROUP BY 1, 2 HAVING count(*) > 5""",
    "chat_over_limit": """
        SELECT user_id, CAST(make_timestamp(CAST(floor(epoch(ts) / 1296000) AS BIGINT) * 1296000000000) AS DATE)
                   AS period_start, count(*) AS requests FROM events
        GROUP BY 1, 2 HAVING count(*) > 30""",
    "request_series": """
        SELECT event_type AS service, CAST(ts AS DATE) AS period_start, count(*) AS requests,
               round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2""",
    "stream_ingest": _t(
        f"SELECT nct_id, overall_status, therapeutic_area, enrollment, n.start_date, n.duration_days,"
        f" outcome_success FROM trials JOIN ({NORMALISED_DATES}) n USING (nct_id)"
    ),
    "snapshot_and_changes": _t(
        f"SELECT nct_id, overall_status, therapeutic_area, enrollment, n.start_date, n.duration_days,"
        f" outcome_success FROM trials JOIN ({NORMALISED_DATES}) n USING (nct_id)"
    ),
    "stream_alarms": """
        WITH c AS (SELECT event_type AS service, CAST(ts AS DATE) AS day, count(*) AS errors FROM events
                   WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) > 65)
        SELECT a.service, a.day AS period_start, least(a.errors, b.errors) AS least_errors,
               a.errors + b.errors AS errors_in_run
        FROM c a JOIN c b ON a.service = b.service AND b.day = a.day - 1""",
    "stream_over_limit": """
        SELECT user_id, CAST(ts AS DATE) AS period_start, count(*) AS requests FROM events
        GROUP BY 1, 2 HAVING count(*) > 5""",
    "raw_documents": _t("SELECT nct_id, nct_id AS kept_id, title AS kept_title FROM trials"),
    "quarantine": _t(
        "SELECT nct_id, CASE WHEN overall_status = 'WITHDRAWN' OR (overall_status = 'SUSPENDED' AND"
        " enrollment IS NOT NULL) THEN 'quarantined' ELSE 'read' END AS state FROM trials"
    ),
    "table_scan": _t("SELECT nct_id, phase, enrollment, start_date, outcome_confidence FROM trials"),
    "job_log": _t(
        """, n AS (SELECT count(*) AS loaded, count(*) FILTER (WHERE overall_status IN
             ('COMPLETED', 'TERMINATED', 'WITHDRAWN')) AS again FROM trials)
        SELECT 'load' AS job_id, 'completed' AS status, loaded AS records_fetched,
               loaded AS records_inserted, 0::BIGINT AS records_updated, CAST(NULL AS VARCHAR) AS error_message FROM n
        UNION ALL SELECT 'broken', 'failed', 0, 0, 0, 'the feed ended early'
        UNION ALL SELECT 'refresh', 'completed', again, 0, again, NULL FROM n"""
    ),
    "prediction_flags": _p("SELECT nct_id, model_version, predicted_label, correct FROM predictions"),
    "prediction_store": _p(
        'SELECT model_version, count(*) AS n, count(*) FILTER (WHERE correct) AS "right"'
        " FROM predictions GROUP BY 1"
    ),
    "metrics_store": _p(
        f""", counts AS (SELECT model_version, CAST(date_trunc('year', start_date) AS DATE) AS trained_at, {_COUNTS}
          FROM predictions p JOIN trials t USING (nct_id) GROUP BY 1, 2)
        SELECT * EXCLUDE (tp, tn, fp, fn) FROM ({_quality("model_version, trained_at")})"""
    ),
    "chart_dispatch": _t(
        f""", kept AS (SELECT * FROM trials WHERE {LAB} AND phase = 'PHASE3'),
        sponsors AS (SELECT 'sponsor_comparison' AS chart, sponsor_class AS label, count(*) AS total FROM kept
                     WHERE sponsor_class IS NOT NULL GROUP BY 2 ORDER BY total DESC, label LIMIT 6)
        SELECT 'success_rate_by_phase' AS chart, phase AS label, count(*) AS total FROM kept GROUP BY 2
        UNION ALL SELECT 'success_rate_by_area', therapeutic_area, count(*) FROM kept GROUP BY 2
        UNION ALL SELECT 'enrollment_distribution', {_bins("enrollment", ENROLLMENT_BINS)}, count(*) FROM kept
            WHERE enrollment IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'trial_volume_over_time', CAST(CAST(date_trunc('year', start_date) AS DATE) AS VARCHAR), count(*)
            FROM kept WHERE start_date IS NOT NULL GROUP BY 2
        UNION ALL SELECT * FROM sponsors
        UNION ALL SELECT 'duration_vs_success', {_bins("duration_days", DURATION_BINS)}, count(*) FROM kept
            WHERE duration_days IS NOT NULL GROUP BY 2"""
    ),
    "score_properties": _t(f"SELECT nct_id, {_FOLLOWS} FROM trials"),
    "score_by_id_properties": _t("SELECT nct_id FROM trials WHERE nct_id = 'NCT00000042'"),
    "design_properties": f"SELECT p_partkey AS design_id, {_FOLLOWS} FROM part",
    "attribution_properties": _t(f"{_RANKED} SELECT nct_id, true AS adds_up FROM dealt WHERE is_test"),
    "importance_properties": " UNION ALL ".join(
        f"SELECT '{n}' AS feature, true AS in_range, true AS adds_up, true AS relative" for n in FEATURE_COLUMNS
    ),
    "fold_properties": _t(
        f"{_RANKED} SELECT fold, count(*) FILTER (WHERE label = 1) AS n_positive,"
        " count(*) FILTER (WHERE label = 0) AS n_negative, true AS in_range FROM dealt GROUP BY 1"
    ),
    "stored_run": _t(
        f"{_RANKED} SELECT 'v1' AS model_version, count(*) FILTER (WHERE NOT is_test) AS n_train,"
        " count(*) FILTER (WHERE is_test) AS n_test, count(*) FILTER (WHERE is_test) AS n_samples,"
        " (SELECT count(*) FROM trials) AS n_scored, 17::BIGINT AS n_importances,"
        " true AS accuracy_holds, true AS f1_holds, true AS areas_hold FROM dealt"
    ),
    "reload_properties": _t("SELECT nct_id FROM trials"),
}
ORACLE["quality_from_histogram"] = (
    f"SELECT * FROM ({ORACLE['metrics_overall']}) JOIN (SELECT model_version, auc_roc FROM ({ORACLE['auc']})) USING (model_version)"
)
ORACLE["calibration_from_histogram"] = ORACLE["calibration"]
