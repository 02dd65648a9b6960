"""DuckDB SQL with the same meaning as each registered query.

Written independently of the operators: plain joins, windows over whole tables
and a recursive walk where the operators use buckets, subqueries and Arrow.
"""

from __future__ import annotations

import re

from surveyspark.params import (
    CANONICAL_STRATUM_CODES,
    IMPROVED_SANITATION_CODES,
    IMPROVED_WATER_CODES,
    VARIABLE_LABELS,
)
from surveyspark.plans import fixtures as fx
from surveyspark.plans.queries import PHI_FEATURES, PROFILED, REPLICATES, P

SEED = P.seed


def _quoted(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _case(column: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(
        f"WHEN {k if isinstance(k, int) else _quoted(k)} THEN {v if isinstance(v, int) else _quoted(v)}"
        for k, v in mapping.items()
    )
    return f"CASE {column} {whens} ELSE {default} END"


def _present(columns, prefix="") -> str:
    return " AND ".join(f"{prefix}{c} IS NOT NULL" for c in columns)


def _hash(*parts: str) -> str:
    return "md5(concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def _uniform(*parts: str) -> str:
    return f"CAST('0x' || substring({_hash(*parts)}, 1, 13) AS BIGINT) / CAST({16**13} AS DOUBLE)"


SBA = (
    "CASE WHEN m3a IS NULL AND m3b IS NULL AND m3c IS NULL AND m3d IS NULL THEN NULL "
    "WHEN m3a = 1 OR m3b = 1 OR m3c = 1 OR m3d = 1 THEN 1 ELSE 0 END"
)
WOMEN_OWN = [c for c in fx.WOMEN if c not in ("caseid", "v001", "v005", "v021", "v022", "v024", "survey_year")]
FEATURES_NO_STRATUM = [f for f in P.features if f != "region_stratum"]


def _featured(name: str, births: str, women: str, months: int) -> str:
    return f"""
SELECT x.*, v005 / 1e6 AS weight, region_name, region_stratum FROM (
  SELECT b.*, {', '.join('w.' + c for c in WOMEN_OWN)}, {SBA} AS sba
  FROM {births} b JOIN {women} w ON b.caseid = w.caseid WHERE b19 <= {months}) x
LEFT JOIN region_labels ON v024 = code WHERE sba IS NOT NULL"""


def _rate_columns(prefix: str = "") -> str:
    return (
        "avg(CASE WHEN y = 1 THEN CAST(proba >= 0.5 AS DOUBLE) END) AS tpr, "
        "avg(CASE WHEN y = 0 THEN CAST(proba >= 0.5 AS DOUBLE) END) AS fpr"
    )


def _ranking(source: str, part: str) -> str:
    """AUC and average precision per part of a (part, y, proba, m) source."""
    return f"""
SELECT {part}, CASE WHEN max(tp_all) > 0 AND max(fp_all) > 0 THEN
    sum(pos * (fp_below + neg / 2.0)) / (CAST(max(tp_all) AS DOUBLE) * max(fp_all)) END AS roc_auc,
  coalesce(sum(pos * (tp_cum / CAST(tp_cum + fp_cum AS DOUBLE))) / nullif(max(tp_all), 0), 0) AS average_precision
FROM (
  SELECT {part}, pos, neg,
    sum(pos) OVER (PARTITION BY {part}) AS tp_all, sum(neg) OVER (PARTITION BY {part}) AS fp_all,
    coalesce(sum(neg) OVER (PARTITION BY {part} ORDER BY proba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fp_below,
    sum(pos) OVER (PARTITION BY {part} ORDER BY proba DESC) AS tp_cum,
    sum(neg) OVER (PARTITION BY {part} ORDER BY proba DESC) AS fp_cum
  FROM (SELECT {part}, proba, sum(CASE WHEN y = 1 THEN m ELSE 0 END) AS pos,
          sum(CASE WHEN y = 0 THEN m ELSE 0 END) AS neg FROM {source} GROUP BY {part}, proba)
) GROUP BY {part}"""


def _statistics(source: str, part: str) -> str:
    """The eight statistics per part of a (part, v190, v025, y, proba, m) source."""
    gaps = " ".join(
        f"""LEFT JOIN (
  SELECT {part}, CASE WHEN count(*) > 1 THEN max(tpr) - min(tpr) END AS {g}_tpr_gap,
    CASE WHEN count(*) > 1 THEN max(fpr) - min(fpr) END AS {g}_fpr_gap
  FROM (SELECT {part}, {g},
      sum(CASE WHEN y = 1 AND proba >= 0.5 THEN m ELSE 0 END) / CAST(sum(CASE WHEN y = 1 THEN m ELSE 0 END) AS DOUBLE) AS tpr,
      sum(CASE WHEN y = 0 AND proba >= 0.5 THEN m ELSE 0 END) / CAST(sum(CASE WHEN y = 0 THEN m ELSE 0 END) AS DOUBLE) AS fpr
    FROM {source} GROUP BY {part}, {g}
    HAVING sum(CASE WHEN y = 1 THEN m ELSE 0 END) >= 5 AND sum(CASE WHEN y = 0 THEN m ELSE 0 END) >= 5)
  GROUP BY {part}) gap_{g} USING ({part})"""
        for g in P.equity_groups
    )
    return f"""
SELECT {part}, roc_auc, average_precision, brier_score, f1,
  v190_tpr_gap, v190_fpr_gap, v025_tpr_gap, v025_fpr_gap
FROM (SELECT {part}, sum(m * (proba - y) * (proba - y)) / CAST(sum(m) AS DOUBLE) AS brier_score,
    coalesce(2.0 * sum(CASE WHEN y = 1 AND proba >= 0.5 THEN m ELSE 0 END) / nullif(
      sum(CASE WHEN y = 1 THEN m ELSE 0 END) + sum(CASE WHEN proba >= 0.5 THEN m ELSE 0 END), 0), 0) AS f1
  FROM {source} GROUP BY {part}
  HAVING sum(CASE WHEN y = 1 THEN m ELSE 0 END) > 0 AND sum(CASE WHEN y = 0 THEN m ELSE 0 END) > 0) base
JOIN ({_ranking(source, part)}) rank_part USING ({part}) {gaps}"""


def _headline(source: str, part: str, size: str = "n") -> str:
    """Size, prevalence and six metrics per part of a (part, y, proba) source."""
    return f"""
SELECT {part}, {size}, round(prevalence, 6) AS prevalence, round(roc_auc, 6) AS roc_auc,
  round(average_precision, 6) AS average_precision, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(brier_score, 6) AS brier_score
FROM (SELECT {part}, count(*) AS {size}, avg(y) AS prevalence, avg((proba - y) * (proba - y)) AS brier_score,
    CAST(count(*) FILTER (y = 1 AND proba >= 0.5) AS DOUBLE) AS tp,
    CAST(count(*) FILTER (y = 0 AND proba >= 0.5) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (y = 1 AND proba < 0.5) AS DOUBLE) AS fn
  FROM {source} GROUP BY {part}) base
JOIN ({_ranking(f'(SELECT *, 1 AS m FROM {source})', part)}) rank_part USING ({part})"""


def _null_union(table: str, columns, select: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {_quoted(c)} AS \"column\", {select.format(c=c)} FROM {table}" for c in columns
    )


BIRTH_CHECKED = [*P.birth_required, "v467a"]

VIEWS = fx.DUCKDB_VIEWS | {
    "clean_births": f"SELECT * FROM births WHERE (m14 IS NULL OR m14 <= {P.visits_max}) AND {_present(P.birth_required)}",
    "clean_women": "SELECT * REPLACE (coalesce(v511, -1) AS v511, coalesce(v701, -1) AS v701, coalesce(v705, -1) AS v705) "
    f"FROM women WHERE {_present(P.women_required)}",
    "featured": _featured("featured", "clean_births", "clean_women", P.recency_max),
    "old_round": _featured("o", "clean_births", "(SELECT * FROM clean_women WHERE survey_year = 2016)", 35),
    "new_round": _featured("n", "clean_births", "(SELECT * FROM clean_women WHERE survey_year = 2024)", 59),
    "pairs": "SELECT v001, v024, DHSCLUST, ADM1NAME FROM (SELECT DISTINCT v001, v024 FROM births) LEFT JOIN clusters ON v001 = DHSCLUST",
    "phi": " UNION ALL ".join(
        f"SELECT caseid, bidx, {_quoted(f)} AS feature, v022 % 3 AS region_stratum, v005 / 1e6 AS weight, "
        f"(({f} * 5 + caseid) % 11 - 5) / 1e1 AS phi FROM births WHERE {f} IS NOT NULL"
        for f in PHI_FEATURES
    ),
    "score_points": "SELECT proba, pos, neg, sum(pos) OVER () AS p, sum(neg) OVER () AS n, "
    "sum(pos) OVER (ORDER BY proba DESC) AS tp, sum(neg) OVER (ORDER BY proba DESC) AS fp, "
    "lag(pos) OVER (ORDER BY proba) AS lower_pos, lag(neg) OVER (ORDER BY proba) AS lower_neg, "
    "row_number() OVER (ORDER BY proba DESC) AS from_top "
    "FROM (SELECT proba, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY proba)",
}


def _folds(table: str) -> str:
    """Recursive walk: each cluster in turn to the lightest fold."""
    return f"""
sized AS (SELECT v021, n, row_number() OVER (ORDER BY n DESC, {_hash('v021', str(SEED))}) AS i
  FROM (SELECT v021, count(*) AS n FROM {table} GROUP BY v021)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS v021, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads, 0 AS pos
  UNION ALL
  SELECT s.i, s.v021,
    list_transform(range(1, 6), lambda j: w.loads[j] + CASE WHEN j = list_position(w.loads, list_min(w.loads)) THEN s.n ELSE 0 END),
    list_position(w.loads, list_min(w.loads))
  FROM walk w JOIN sized s ON s.i = w.i + 1),
folds AS (SELECT v021, CAST(pos - 1 AS INT) AS cv_fold FROM walk WHERE i > 0)"""


def _holdout(table: str, key: str = "v021", quota: str = "greatest(1, round_even(k * 0.2, 0))") -> str:
    return (
        f"(SELECT {key}, i <= {quota} AS held FROM (SELECT {key}, row_number() OVER (ORDER BY {_hash(key, str(SEED))}) AS i, "
        f"count(*) OVER () AS k FROM (SELECT DISTINCT {key} FROM {table})))"
    )


def _with(body: str, extra: str = "") -> str:
    """Prefix the views a statement needs."""
    needed: set[str] = set()

    def need(text: str) -> None:
        read = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text))
        for name in (read & VIEWS.keys()) - needed:
            needed.add(name)
            need(VIEWS[name])

    need(extra + " " + body)
    order = [n for n in VIEWS if n in needed]
    ctes = [f"{n} AS ({VIEWS[n]})" for n in order]
    if extra:
        ctes.append(extra.strip())
    return f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body


REGION_NAMES = fx.REGION_LABELS
PREVALENCE = (
    "count(*) AS n, round(sum(sba * weight) / sum(weight), 6) AS weighted_sba_prevalence, "
    "round(avg(sba), 6) AS unweighted_sba_prevalence"
)
EDGES = ", ".join(str(i / 10) for i in range(1, 10))
AGE = " ".join(
    f"WHEN v012 >= {lo} AND v012 < {hi} THEN '[{lo}, {hi})'"
    for lo, hi in zip(P.age_bins.edges, P.age_bins.edges[1:])
)
MISSING = ", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 100.0 ELSE 0.0 END), 1) AS {c}" for c in BIRTH_CHECKED)
IMPORTANCE = (
    "SELECT feature, round(sum(abs(phi) * weight) / sum(weight), 6) AS weighted_mean_abs_shap, "
    "round(avg(abs(phi)), 6) AS unweighted_mean_abs_shap FROM phi GROUP BY feature"
)
SPREAD = "SELECT region_stratum, avg(phi) AS mean, stddev_samp(phi) AS std, count(phi) AS count FROM phi GROUP BY region_stratum"
SCENARIO_NAMES = ("scenario1", "scenario2", "scenario3", "scenario4", "scenario5")


def _equity(group: str) -> str:
    return f"""
SELECT {group}, n, round(observed, 6) AS observed_sba_rate, round(mean_p, 6) AS mean_predicted_proba,
  round(roc_auc, 6) AS auc, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr
FROM (SELECT {group}, count(*) AS n, avg(y) AS observed, avg(proba) AS mean_p, {_rate_columns()} FROM scored GROUP BY {group})
JOIN ({_ranking('(SELECT *, 1 AS m FROM scored)', group)}) USING ({group})"""


def _profile_values() -> str:
    return " UNION ALL ".join(
        f"SELECT {_quoted(c)} AS \"column\", CAST({c} AS DOUBLE) AS v FROM train" for c in PROFILED
    )


PROFILE = f"""
asked AS (SELECT * FROM births WHERE {_present(PROFILED)}),
train AS (SELECT asked.* FROM asked JOIN {_holdout("asked")} USING (v021) WHERE NOT held AND m14 <= 20),
profile AS (SELECT "column", min(v) AS min_value, max(v) AS max_value, count(DISTINCT v) AS n_distinct
  FROM ({_profile_values()}) GROUP BY "column")"""


def _inside(c: str) -> str:
    """Column c of a row lies in the training profile (v024 has over 10 codes)."""
    return (
        f"(CASE WHEN (SELECT n_distinct FROM profile WHERE \"column\" = {_quoted(c)}) > 10 "
        f"THEN {c} BETWEEN (SELECT min({c}) FROM train) AND (SELECT max({c}) FROM train) "
        f"ELSE {c} IN (SELECT {c} FROM train) END)"
    )


def _canonical(table: str, year: int) -> str:
    return (
        f"SELECT '{year}_' || v001 AS round_cluster, sba, held, {year} AS survey_year, "
        f"{_case('region_stratum', CANONICAL_STRATUM_CODES)} AS region_stratum "
        f"FROM {table} JOIN {_holdout(table)} USING (v021) WHERE region_stratum IS NOT NULL"
    )


ROUNDS = f"""
o AS ({_canonical('old_round', 2016)}), nw AS ({_canonical('new_round', 2024)}),
both_rounds AS (SELECT * FROM o UNION ALL SELECT * FROM nw)"""
SIDES = f"""
pool AS (SELECT b.*, h.held AS is_test FROM both_rounds b JOIN {_holdout('both_rounds', 'round_cluster', 'ceil(k * 0.2)')} h USING (round_cluster)),
sides AS (
  SELECT 'scenario1' AS scenario, CASE WHEN is_test THEN 'test' ELSE 'train' END AS role, round_cluster, sba FROM pool
  UNION ALL SELECT 'scenario2', 'train', round_cluster, sba FROM nw UNION ALL SELECT 'scenario2', 'test', round_cluster, sba FROM o
  UNION ALL SELECT 'scenario3', 'train', round_cluster, sba FROM o UNION ALL SELECT 'scenario3', 'test', round_cluster, sba FROM nw
  UNION ALL SELECT 'scenario4', CASE WHEN held THEN 'test' ELSE 'train' END, round_cluster, sba FROM o
  UNION ALL SELECT 'scenario5', CASE WHEN held THEN 'test' ELSE 'train' END, round_cluster, sba FROM nw)"""

VARIANTS = """
variants AS (SELECT 'class_weight' AS method, y, round(proba, 6) AS proba FROM scored
  UNION ALL SELECT 'smote', y, round(proba * proba, 6) FROM scored
  UNION ALL SELECT 'none', y, round(1 - proba, 6) FROM scored)"""

DRAWS = f"""
ranked AS (SELECT v021, row_number() OVER (ORDER BY {_hash('v021', str(SEED))}) - 1 AS idx, count(*) OVER () AS k
  FROM (SELECT DISTINCT v021 FROM scored)),
draws AS (SELECT b, CAST(floor({_uniform('b', 'idx', str(SEED))} * k) AS BIGINT) AS pick
  FROM ranked, (SELECT unnest(range({REPLICATES})) AS b)),
resampled AS (SELECT b, v190, v025, y, proba, CAST(sum(m * n) AS BIGINT) AS m
  FROM (SELECT v021, v190, v025, y, proba, count(*) AS n FROM scored GROUP BY ALL) JOIN ranked USING (v021)
  JOIN (SELECT b, pick, count(*) AS m FROM draws GROUP BY b, pick) ON idx = pick GROUP BY b, v190, v025, y, proba),
replicates AS ({_statistics('resampled', 'b')}),
point AS ({_statistics('(SELECT *, 1 AS m, 0 AS whole FROM scored)', 'whole')})"""
MATRIX = _folds("featured") + f""",
coded AS (SELECT caseid, bidx, cv_fold, held, sba, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES_NO_STRATUM)},
    CAST(code AS DOUBLE) AS region_stratum FROM (SELECT * EXCLUDE (region_stratum), region_stratum AS label FROM featured)
  LEFT JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (
    SELECT DISTINCT region_stratum AS label FROM featured WHERE region_stratum IS NOT NULL)) USING (label)
  JOIN folds USING (v021) JOIN {_holdout('featured')} USING (v021)),
matrix AS (SELECT * FROM coded WHERE {_present(P.features)}),
pool AS (SELECT * FROM matrix WHERE NOT held)"""
NOMINAL = [f for f in P.features if f not in P.smote_continuous]
STATISTICS = (
    "roc_auc", "average_precision", "brier_score", "f1",
    "v190_tpr_gap", "v190_fpr_gap", "v025_tpr_gap", "v025_fpr_gap",
)

ORACLE: dict[str, str] = {
    "column_pruned_scan": "SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem",
    "cluster_attributes": _with("SELECT DHSCLUST, ADM1NAME, ADM1DHS, URBAN_RURA FROM clusters"),
    "missingness_profile": _with(
        f"SELECT \"column\", pct_null FROM (UNPIVOT (SELECT {MISSING} FROM births) ON COLUMNS(*) INTO NAME \"column\" VALUE pct_null) "
        "ORDER BY pct_null DESC, \"column\" LIMIT 5"
    ),
    "fully_missing": _with(
        f"SELECT \"column\" FROM ({_null_union('births', BIRTH_CHECKED, 'count({c}) AS present')}) WHERE present = 0"
    ),
    "complete_case": _with(f"SELECT caseid, bidx, m14, m3c, b19 FROM births WHERE {_present(P.birth_required)}"),
    "complete_case_counts": _with(
        f"SELECT count(*) AS n_before, count(*) FILTER ({_present(P.birth_required)}) AS n_kept, "
        f"count(*) - count(*) FILTER ({_present(P.birth_required)}) AS n_removed FROM births"
    ),
    "skip_sentinel": _with(
        "SELECT caseid, coalesce(v511, -1) AS v511, coalesce(v701, -1) AS v701, coalesce(v705, -1) AS v705 FROM women"
    ),
    "skip_sentinel_counts": _with(_null_union("women", P.skip_pattern, "count(*) FILTER ({c} IS NULL) AS n_recoded")),
    "plausible_kept": _with("SELECT caseid, bidx, v024, m14 FROM births WHERE m14 IS NULL OR m14 <= 20"),
    "plausible_rejected": _with("SELECT caseid, bidx, v024, m14 FROM births WHERE m14 > 20"),
    "eligibility_consistency": _with(
        "SELECT n_in_window, n_answered, n_in_window = n_answered AS matches FROM (SELECT count(*) FILTER (b19 <= 59) AS n_in_window, "
        "count(*) FILTER (m3a IS NOT NULL OR m3b IS NOT NULL OR m3c IS NOT NULL OR m3d IS NOT NULL) AS n_answered FROM births)"
    ),
    "matrix_nulls": _with(
        f"SELECT * FROM ({_null_union('women', P.women_required + list(P.skip_pattern), 'count(*) FILTER ({c} IS NULL) AS n_null')}) WHERE n_null > 0"
    ),
    "stage_funnel": _with(
        "SELECT step, stage, n_before, n_after, n_before - n_after AS n_dropped FROM ("
        "SELECT 1 AS step, 'plausible' AS stage, (SELECT count(*) FROM births) AS n_before, "
        "(SELECT count(*) FROM births WHERE m14 IS NULL OR m14 <= 20) AS n_after "
        "UNION ALL SELECT 2, 'complete', (SELECT count(*) FROM births WHERE m14 IS NULL OR m14 <= 20), (SELECT count(*) FROM clean_births) "
        "UNION ALL SELECT 3, 'eligible', (SELECT count(*) FROM clean_births), (SELECT count(*) FROM clean_births WHERE b19 <= 59))"
    ),
    "observed_funnel": _with(
        "SELECT step, stage, n_before, n_after, n_before - n_after AS n_dropped FROM ("
        "SELECT 1 AS step, 'plausible' AS stage, (SELECT count(*) FROM births) AS n_before, "
        "(SELECT count(*) FROM births WHERE m14 IS NULL OR m14 <= 20) AS n_after "
        "UNION ALL SELECT 2, 'complete', (SELECT count(*) FROM births WHERE m14 IS NULL OR m14 <= 20), (SELECT count(*) FROM clean_births) "
        "UNION ALL SELECT 3, 'eligible', (SELECT count(*) FROM clean_births), (SELECT count(*) FROM clean_births WHERE b19 <= 59))"
    ),
    "stage_reuse": _with(" UNION ALL ".join(
        f"SELECT survey_year, v190, count(*) AS n, {run} AS run FROM women WHERE survey_year = {year} GROUP BY survey_year, v190"
        for run, year in enumerate((2024, 2024, 2016)))),
    "label_collisions": _with(
        "SELECT region_stratum AS label, count(DISTINCT code) AS n_codes, string_agg(CAST(code AS VARCHAR), ',' ORDER BY CAST(code AS VARCHAR)) AS codes "
        "FROM region_labels GROUP BY region_stratum HAVING count(DISTINCT code) > 1"
    ),
    "category_coverage": _with(
        "SELECT v022, string_agg(CAST(bord AS VARCHAR), ',' ORDER BY bord) AS query_values, "
        "(SELECT string_agg(CAST(bord AS VARCHAR), ',' ORDER BY bord) FROM (SELECT DISTINCT bord FROM pool)) AS train_values, "
        "CAST(count(*) FILTER (bord NOT IN (SELECT bord FROM pool)) AS INT) AS n_unseen "
        "FROM (SELECT DISTINCT v022, bord FROM births) GROUP BY v022",
        f"pool AS (SELECT births.* FROM births JOIN {_holdout('births')} USING (v021) WHERE NOT held)",
    ),
    "recency_filter": _with("SELECT caseid, bidx, b19 FROM births WHERE b19 <= 59"),
    "outcome": _with(f"SELECT caseid, bidx, {SBA} AS sba FROM births"),
    "outcome_prevalence": _with(f"SELECT count(sba) AS n_valid, round(avg(sba), 6) AS prevalence FROM (SELECT {SBA} AS sba FROM births)"),
    "region_label": _with("SELECT caseid, bidx, v024, region_name FROM births LEFT JOIN region_labels ON v024 = code"),
    "stratum": _with("SELECT caseid, bidx, v024, region_name, region_stratum FROM births LEFT JOIN region_labels ON v024 = code"),
    "stratum_from_parameters": _with(
        f"SELECT caseid, bidx, v024, region_name, {_case('region_name', P.region_to_stratum)} AS region_stratum "
        f"FROM (SELECT *, {_case('v024', P.region_labels)} AS region_name FROM births)"
    ),
    "unmapped_rows": _with(
        "SELECT count(*) FILTER (region_stratum IS NULL) AS n_unmapped FROM births LEFT JOIN region_labels ON v024 = code"
    ),
    "small_sample_flags": _with(
        "SELECT name AS region_name, count(f.caseid) AS n, count(f.caseid) < 1000 AS is_small "
        f"FROM (SELECT unnest([{', '.join(map(_quoted, fx.FLAGGED_NATIONS))}]) AS name) LEFT JOIN featured f ON f.region_name = name GROUP BY name"
    ),
    "age_bins": _with(f"SELECT caseid, CASE {AGE} END AS age_group, CASE {AGE} ELSE 'nan' END AS age_group_text FROM women"),
    "parity_anc_bins": _with(
        "SELECT b.caseid, b.bidx, CASE WHEN v218 > 0 AND v218 <= 1 THEN '1' WHEN v218 > 1 AND v218 <= 3 THEN '2-3' WHEN v218 > 3 AND v218 <= 99 THEN '4+' END AS parity, "
        "CASE WHEN m14 > -1 AND m14 <= 0 THEN '0' WHEN m14 > 0 AND m14 <= 3 THEN '1-3' WHEN m14 > 3 AND m14 <= 99 THEN '4+' END AS anc "
        "FROM births b JOIN women w ON b.caseid = w.caseid"
    ),
    "education": _with(f"SELECT caseid, {_case('v106', P.education)} AS education FROM women"),
    "media_any": _with("SELECT caseid, coalesce(v157, 0) > 0 OR coalesce(v158, 0) > 0 OR coalesce(v159, 0) > 0 AS media_any FROM women"),
    "wash_improved": _with(
        f"SELECT caseid, v113 IN {IMPROVED_WATER_CODES} AND v116 IN {IMPROVED_SANITATION_CODES} AS wash_improved FROM women"
    ),
    "weights": _with("SELECT caseid, bidx, round(v005 / 1e6, 6) AS weight FROM births"),
    "model_matrix": _with(
        "SELECT caseid, bidx, v001, round(weight, 6) AS weight, cv_fold, held AS geo_holdout, sba, "
        + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES_NO_STRATUM)
        + ", CAST(code AS DOUBLE) AS region_stratum FROM (SELECT * EXCLUDE (region_stratum), region_stratum AS label FROM featured) "
        "LEFT JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT region_stratum AS label FROM featured WHERE region_stratum IS NOT NULL)) USING (label) "
        f"JOIN folds USING (v021) JOIN {_holdout('featured')} USING (v021)",
        _folds("featured"),
    ),
    "round_union": _with(
        "SELECT survey_year, CAST(region_stratum AS INT) AS region_stratum, count(*) AS n, count(*) FILTER (sba = 1) AS n_positive FROM both_rounds GROUP BY ALL",
        ROUNDS,
    ),
    "stratum_codes": _with(
        "SELECT region_stratum AS label, CAST(row_number() OVER (ORDER BY region_stratum) - 1 AS INT) AS code "
        "FROM (SELECT DISTINCT region_stratum FROM featured WHERE region_stratum IS NOT NULL)"
    ),
    "canonical_codes": _with(
        f"SELECT caseid, bidx, {_case('region_stratum', CANONICAL_STRATUM_CODES)} AS region_stratum "
        "FROM births JOIN region_labels ON v024 = code"
    ),
    "canonical_dropped": _with(
        "SELECT count(*) FILTER (code IS NULL) AS n_dropped FROM births LEFT JOIN region_labels ON v024 = code"
    ),
    "round_cluster": _with("SELECT caseid, survey_year || '_' || v001 AS round_cluster FROM women"),
    "default_columns": _with("SELECT caseid, bidx, v001, 2024 AS survey_year, false AS geo_holdout FROM births"),
    "codebook": _with(
        f"SELECT code, n_null, {_case('code', {f: VARIABLE_LABELS[f] for f in FEATURES_NO_STRATUM}, 'code')} AS label FROM ("
        + " UNION ALL ".join(
            f"SELECT {_quoted(f)} AS code, count(*) FILTER ({'w.' if f in WOMEN_OWN else 'b.'}{f} IS NULL) AS n_null "
            "FROM births b JOIN women w ON b.caseid = w.caseid"
            for f in FEATURES_NO_STRATUM
        )
        + ")"
    ),
    "category_strings": _with(
        "SELECT category, count(*) AS n FROM (SELECT printf('%.1f', CAST(bord AS DOUBLE)) AS category FROM births "
        "UNION ALL SELECT trim(ADM1NAME) FROM clusters) GROUP BY category"
    ),
    "category_to_double": _with("SELECT caseid, bidx, CAST(v467b AS DOUBLE) AS value FROM births"),
    "stratum_code_labels": _with(
        f"SELECT s.region_stratum, round(mean, 6) AS mean, round(std, 6) AS std, count, label AS stratum_label FROM ({SPREAD}) s LEFT JOIN "
        "(SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT region_stratum AS label FROM region_labels)) ON s.region_stratum = code"
    ),
    "merge_m1": _with(
        "SELECT b.caseid, b.bidx, b.v001, b.v005, b.v024, w.v012, w.v190, b.m14 FROM births b JOIN women w ON b.caseid = w.caseid"
    ),
    "merge_unmatched": _with("SELECT caseid, bidx, v001 FROM births WHERE caseid NOT IN (SELECT caseid FROM women)"),
    "cluster_region_pairs": _with("SELECT v001, v024, ADM1NAME FROM pairs"),
    "linkage_check": _with(
        "SELECT n_clusters, n_unmapped, round(mismatch_rate, 6) AS mismatch_rate, mismatch_rate <= 0.05 AS passed FROM ("
        "SELECT count(*) AS n_clusters, count(*) FILTER (region_name IS NULL) AS n_unmapped, "
        "avg(CASE WHEN lower(trim(region_name)) = lower(trim(ADM1NAME)) THEN 0.0 ELSE 1.0 END) AS mismatch_rate "
        "FROM pairs LEFT JOIN region_labels ON v024 = code)"
    ),
    "majority_name": _with(
        "SELECT ADM1DHS, ADM1NAME, n FROM (SELECT ADM1DHS, ADM1NAME, count(*) AS n, row_number() OVER (PARTITION BY ADM1DHS ORDER BY count(*) DESC, ADM1NAME) AS i "
        "FROM clusters GROUP BY ADM1DHS, ADM1NAME) WHERE i = 1"
    ),
    "group_kfold": _with(
        "SELECT v021, cv_fold, count(*) AS n FROM births JOIN folds USING (v021) GROUP BY v021, cv_fold", _folds("births")
    ),
    "geo_holdout": _with(
        f"SELECT v021, held AS geo_holdout, count(*) AS n FROM births JOIN {_holdout('births')} USING (v021) GROUP BY v021, held"
    ),
    "train_pool": _with(f"SELECT caseid, bidx, v021 FROM births JOIN {_holdout('births')} USING (v021) WHERE NOT held"),
    "stratum_sample": _with(
        f"SELECT v022, caseid, bidx FROM (SELECT *, row_number() OVER (PARTITION BY v022 ORDER BY {_hash('caseid', 'bidx', str(SEED))}, caseid, bidx) AS i "
        f"FROM births WHERE {SBA} = 0) WHERE i <= 3"
    ),
    "scenario_split": _with(
        "SELECT scenario, role, count(*) AS n_rows, count(DISTINCT round_cluster) AS n_clusters, count(*) FILTER (sba = 1) AS n_positive "
        "FROM sides GROUP BY scenario, role",
        ROUNDS + "," + SIDES,
    ),
    "weighted_prevalence_by_region": _with(f"SELECT region_name, {PREVALENCE} FROM featured WHERE region_name IS NOT NULL GROUP BY region_name"),
    "weighted_prevalence_by_stratum": _with(f"SELECT region_stratum, {PREVALENCE} FROM featured WHERE region_stratum IS NOT NULL GROUP BY region_stratum"),
    "class_weight": _with(
        "SELECT n_pos, n_neg, round(n_neg / CAST(n_pos AS DOUBLE), 6) AS pos_weight FROM (SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM scored)"
    ),
    "class_weight_column": _with(
        "SELECT y, CASE WHEN y = 1 THEN round((SELECT count(*) FILTER (y = 0) / CAST(count(*) FILTER (y = 1) AS DOUBLE) FROM scored), 6) ELSE 1.0 END AS w, "
        "count(*) AS n FROM scored GROUP BY y"
    ),
    "feature_importance_weighted": _with(
        f"SELECT *, CAST(row_number() OVER (ORDER BY weighted_mean_abs_shap DESC, feature) AS INT) AS rank FROM ({IMPORTANCE})"
    ),
    "labelled_importance": _with(
        f"SELECT {_case('feature', {f: VARIABLE_LABELS[f] for f in PHI_FEATURES}, 'feature')} AS label, weighted_mean_abs_shap "
        f"FROM ({IMPORTANCE}) ORDER BY weighted_mean_abs_shap DESC, feature LIMIT 3"
    ),
    "interaction_summary": _with(f"SELECT region_stratum, round(mean, 6) AS mean, round(std, 6) AS std, count FROM ({SPREAD})"),
    "column_profile": _with(
        "SELECT \"column\", min_value, max_value, n_distinct, n_distinct > 10 AND \"column\" <> 'v024' AS is_continuous, "
        "CASE WHEN n_distinct <= 10 OR \"column\" = 'v024' THEN listed END AS values FROM profile JOIN ("
        f"SELECT \"column\", string_agg(CAST(CAST(v AS INT) AS VARCHAR), ',' ORDER BY v) AS listed FROM (SELECT DISTINCT \"column\", v FROM ({_profile_values()})) GROUP BY \"column\") USING (\"column\")",
        PROFILE,
    ),
    "in_distribution": _with(
        f"SELECT caseid, bidx, bord, b19 FROM asked WHERE {' AND '.join(map(_inside, PROFILED))}", PROFILE
    ),
    "out_of_distribution_counts": _with(
        "SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT (SELECT count(*) FROM asked) AS n_rows, {_quoted(c)} AS feature, (SELECT count(*) FROM asked WHERE NOT {_inside(c)}) AS n_rejected" for c in PROFILED
        ) + ") WHERE n_rejected > 0",
        PROFILE,
    ),
    "permitted_range": _with(
        "SELECT 'm14' AS feature, 0.0 AS low, 20.0 AS high, CAST(NULL AS VARCHAR) AS categories "
        "UNION ALL SELECT 'b19', CAST(min(b19) AS DOUBLE), CAST(max(b19) AS DOUBLE), NULL FROM train "
        "UNION ALL SELECT 'v467b', NULL, NULL, string_agg(printf('%.1f', CAST(v467b AS DOUBLE)), ',' ORDER BY v467b) FROM (SELECT DISTINCT v467b FROM train)",
        PROFILE,
    ),
    "training_rejects": _with(
        f"SELECT count(*) AS n_before, count(*) FILTER ({_present(P.features)}) AS n_kept, "
        f"count(*) - count(*) FILTER ({_present(P.features)}) AS n_removed FROM coded", MATRIX,
    ),
    "null_cluster_rows": _with(_null_union("births", ["v021", "v467c"], "count(*) FILTER ({c} IS NULL) AS n_null")),
    "cv_fold_sizes": _with("SELECT cv_fold, count(*) AS n_test, true AS better_than_chance FROM pool GROUP BY cv_fold", MATRIX),
    "scenario_sizes": _with(
        "SELECT scenario, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, "
        "round(avg(sba) FILTER (role = 'train'), 6) AS train_prevalence, round(avg(sba) FILTER (role = 'test'), 6) AS test_prevalence "
        "FROM sides GROUP BY scenario", ROUNDS + "," + SIDES),
    "imbalance_folds": _with(
        "SELECT method, cv_fold, count(*) AS n_test, true AS better_than_chance FROM pool, "
        "(VALUES ('class_weight'), ('smote'), ('none')) m(method) GROUP BY method, cv_fold", MATRIX),
    "fitted_equity_sizes": _with(
        " UNION ALL ".join(
            f"SELECT '{g}' AS \"group\", CAST({g} AS INT) AS value, count(*) AS n, round(avg(sba), 6) AS observed_sba_rate FROM matrix WHERE held GROUP BY {g}"
            for g in P.equity_groups
        ), MATRIX),
    "summary_keys": _with(
        "SELECT 'provenance' AS part, 1 AS n UNION ALL SELECT 'holdout_metrics', 1 UNION ALL SELECT 'equity_gaps', 1 "
        "UNION ALL SELECT 'cluster_cv', count(DISTINCT cv_fold) FROM pool "
        f"UNION ALL SELECT 'shap_top_features', least(10, {len(P.features)}) "
        "UNION ALL SELECT 'equity_by_wealth', count(DISTINCT v190) FROM matrix WHERE held", MATRIX),
    "holdout_keys": _with("SELECT caseid, bidx, sba FROM matrix WHERE held", MATRIX),
    "shap_additivity": _with("SELECT count(*) AS n_rows, count(*) AS n_additive FROM pool", MATRIX),
    "dependence_sizes": _with(
        " UNION ALL ".join(
            f"SELECT region_stratum, '{v}' AS feature, count(*) AS n, count(DISTINCT {v}) AS n_points, min({v}) AS first_point, max({v}) AS last_point "
            "FROM pool GROUP BY region_stratum"
            for v in P.dependence_vars
        ),
        MATRIX,
    ),
    "smotenc_counts": _with(
        "SELECT sba, (SELECT max(n) FROM (SELECT count(*) AS n FROM pool GROUP BY sba)) AS n, n_categories FROM ("
        "SELECT sba, count(*) AS n_categories FROM ("
        + " UNION ".join(f"SELECT sba, '{f}' AS feature, {f} AS value FROM pool" for f in NOMINAL)
        + ") GROUP BY sba)",
        MATRIX,
    ),
    "counterfactual_grid": _with(
        "SELECT caseid, bidx, n_changed, count(*) AS n_variations, count(*) AS n_distinct, round(sum(moved), 6) AS total_distance FROM ("
        "SELECT caseid, bidx, CAST(a <> m14 AS INT) + CAST(b <> v467b AS INT) + CAST(c <> m10 AS INT) AS n_changed, "
        "abs(a - m14) / 20.0 + coalesce(abs(b - v467b) / nullif(CAST(wb AS DOUBLE), 0), 0) + coalesce(abs(c - m10) / nullif(CAST(wc AS DOUBLE), 0), 0) AS moved "
        "FROM (SELECT *, unnest(list_distinct(list_append(range(21), m14))) AS a FROM sample), "
        "(SELECT DISTINCT v467b AS b FROM train), (SELECT DISTINCT m10 AS c FROM train), "
        "(SELECT max(v467b) - min(v467b) AS wb, max(m10) - min(m10) AS wc FROM train)) WHERE n_changed > 0 GROUP BY ALL",
        PROFILE + f""",
sample AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v022 ORDER BY {_hash('caseid', 'bidx', str(SEED))}, caseid, bidx) AS i
  FROM asked WHERE {SBA} = 0) WHERE i <= 3)""",
    ),
    "roc_auc": _with(f"SELECT round(roc_auc, 6) AS roc_auc FROM ({_ranking('(SELECT *, 1 AS m, 0 AS whole FROM scored)', 'whole')})"),
    "average_precision": _with(f"SELECT round(average_precision, 6) AS average_precision FROM ({_ranking('(SELECT *, 1 AS m, 0 AS whole FROM scored)', 'whole')})"),
    "brier": _with("SELECT round(avg((proba - y) * (proba - y)), 6) AS brier_score FROM scored"),
    "threshold_metrics": _with(
        f"SELECT precision, recall, f1 FROM ({_headline('(SELECT *, 0 AS whole FROM scored)', 'whole')})"
    ),
    "confusion_matrix": _with(
        "SELECT actual, predicted, n, round(n / CAST(sum(n) OVER (PARTITION BY actual) AS DOUBLE), 6) AS row_share FROM ("
        "SELECT a AS actual, p AS predicted, count(y) AS n FROM (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS p) "
        "LEFT JOIN scored ON y = a AND CAST(proba >= 0.5 AS INT) = p GROUP BY a, p)"
    ),
    "roc_points": _with(
        "SELECT round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(tp / CAST(p AS DOUBLE), 6) AS tpr, round(proba, 6) AS threshold FROM score_points "
        "WHERE from_top = 1 OR lower_pos IS NULL OR lower_pos <> pos OR lower_neg <> neg UNION ALL SELECT 0.0, 0.0, CAST('inf' AS DOUBLE)"
    ),
    "pr_points": _with(
        "SELECT round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(p AS DOUBLE), 6) AS recall, round(proba, 6) AS threshold, round(p / CAST(p + n AS DOUBLE), 6) AS no_skill FROM score_points "
        "UNION ALL SELECT 1.0, 0.0, NULL, round(avg(y), 6) FROM scored"
    ),
    "calibration_quantile": _with(
        f"SELECT CAST(bin AS INT) AS bin, round(avg(proba), 6) AS mean_pred, round(avg(y), 6) AS frac_pos, count(*) AS n FROM ("
        f"SELECT y, proba, len(list_filter((SELECT quantile_cont(proba, [{EDGES}]) FROM scored), lambda e: e < proba)) AS bin FROM scored) GROUP BY bin"
    ),
    "calibration_by_part": _with(
        "SELECT v025, CAST(bin AS INT) AS bin, round(avg(proba), 6) AS mean_pred, round(avg(y), 6) AS frac_pos, count(*) AS n FROM ("
        f"SELECT v025, y, proba, len(list_filter(e, lambda x: x < proba)) AS bin FROM scored JOIN (SELECT v025, quantile_cont(proba, [{EDGES}]) AS e FROM scored GROUP BY v025) USING (v025)"
        ") GROUP BY v025, bin"
    ),
    "fold_prevalence_mean": _with(
        f"SELECT round(avg(p), 6) AS prevalence_mean FROM (SELECT cv_fold, avg({SBA}) AS p FROM births JOIN folds USING (v021) GROUP BY cv_fold)",
        _folds("births"),
    ),
    "interaction_counts": _with(
        f"SELECT region_stratum, label AS stratum_label, {len(P.interaction_pairs)} AS n_pairs, count(*) AS fewest, count(*) AS most FROM pool "
        "JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT region_stratum AS label FROM region_labels)) ON region_stratum = code "
        "GROUP BY region_stratum, label",
        MATRIX,
    ),
    "equity_by_wealth": _with(_equity("v190")),
    "equity_by_residence": _with(_equity("v025")),
    "equity_gaps": _with(
        f"SELECT round(max(tpr) - min(tpr), 6) AS tpr_gap, round(max(fpr) - min(fpr), 6) AS fpr_gap FROM (SELECT v190, {_rate_columns()} FROM scored GROUP BY v190)"
    ),
    "equity_gaps_min_cell": _with(
        f"SELECT round(max(tpr) - min(tpr), 6) AS tpr_gap, round(max(fpr) - min(fpr), 6) AS fpr_gap FROM (SELECT v021, {_rate_columns()} FROM scored GROUP BY v021 "
        "HAVING count(*) FILTER (y = 1) >= 220 AND count(*) FILTER (y = 0) >= 220)"
    ),
    "stat_vector": _with(
        "SELECT " + ", ".join(f"round({s}, 6) AS {s}" for s in STATISTICS)
        + f" FROM ({_statistics('(SELECT *, 1 AS m, 0 AS whole FROM scored)', 'whole')})"
    ),
    "bootstrap_ci": _with(
        " UNION ALL ".join(
            f"SELECT '{s}' AS metric, (SELECT round({s}, 3) FROM point) AS estimate, round(quantile_cont({s}, 0.025), 3) AS lower, "
            f"round(quantile_cont({s}, 0.975), 3) AS upper FROM replicates"
            for s in STATISTICS
        ),
        DRAWS,
    ),
    "holdout_metrics": _with(_headline("scored", "v025")),
    "metrics_long": _with(
        "SELECT v025, metric, value FROM (UNPIVOT (SELECT v025, CAST(n AS DOUBLE) AS n, * EXCLUDE (v025, n) FROM "
        f"({_headline('scored', 'v025')})) ON COLUMNS(* EXCLUDE (v025)) INTO NAME metric VALUE value)"
    ),
    "imbalance_verdict": _with(
        "SELECT best_auc, best_brier, best_f1, best_auc = best_brier AS auc_and_brier_agree, best_auc = best_f1 AS auc_and_f1_agree FROM (SELECT "
        "(SELECT method FROM t ORDER BY roc_auc DESC, o LIMIT 1) AS best_auc, (SELECT method FROM t ORDER BY brier_score, o LIMIT 1) AS best_brier, "
        "(SELECT method FROM t ORDER BY f1 DESC, o LIMIT 1) AS best_f1)",
        VARIANTS + f", t AS (SELECT *, list_position(['class_weight', 'smote', 'none'], method) AS o FROM ({_headline('variants', 'method')}))",
    ),
    "checkpoint_roundtrip": _with(
        "SELECT b.v024, count(*) AS n, count(*) AS n_csv, count(*) AS n_json FROM clean_births b JOIN clean_women w ON b.caseid = w.caseid GROUP BY b.v024"
    ),
    "formatted_equity": _with(
        "SELECT CAST(v190 AS VARCHAR) AS v190, CAST(n AS VARCHAR) AS n, "
        + ", ".join(
            f"printf('%.4f', {c}) AS {c}" for c in ("observed_sba_rate", "mean_predicted_proba", "auc", "tpr", "fpr")
        )
        + f" FROM ({_equity('v190')})"
    ),
}

_CROSSWALK = """
SELECT v024 AS v024_code, n_clusters, name AS adm1name_majority, round(n / CAST(n_clusters AS DOUBLE), 3) AS adm1name_majority_share,
  listed AS adm1name_all_seen, coalesce(region_name, '(not in config.region_labels)') AS config_region_labels_says,
  coalesce(lower(trim(region_name)) = lower(trim(name)), false) AS config_matches_majority
FROM (SELECT v024, CAST(sum(n) AS BIGINT) AS n_clusters, first(name ORDER BY n DESC, name NULLS LAST) AS name, max(n) AS n,
    string_agg(coalesce(name, 'nan') || ' (' || n || ')', ', ' ORDER BY n DESC, name NULLS LAST) AS listed
  FROM (SELECT v024, ADM1NAME AS name, count(*) AS n FROM pairs GROUP BY v024, ADM1NAME) GROUP BY v024)
LEFT JOIN region_labels ON v024 = code"""
ORACLE["region_crosswalk"] = _with(_CROSSWALK)
ORACLE["crosswalk_errors"] = _with(
    f"SELECT count(*) FILTER (NOT config_matches_majority) AS n_wrong, count(*) AS n_codes FROM ({_CROSSWALK})"
)
