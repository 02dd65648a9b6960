"""Survey-shaped views over the test tables.

Each view is a list of (column, SQL expression). The expressions are plain SQL
that means the same in Spark and in DuckDB, so the query side and the oracle
side derive their inputs from one definition and share nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Identity of a birth within its order: part, line, quantity and ship date packed
# into one number. Unlike a row number it needs no window, so the rows of an order
# are never gathered.
_ROW_ID = (
    "((l_partkey * 8 + l_linenumber) * 64 + CAST(l_quantity AS BIGINT)) * 8192 "
    "+ (year(l_shipdate) - 1990) * 372 + month(l_shipdate) * 31 + day(l_shipdate)"
)

_ATTENDED = "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE {} END"

BIRTHS = {
    "caseid": "l_orderkey",
    "bidx": _ROW_ID,
    "v001": "l_suppkey",
    "v021": "l_suppkey",
    "v022": "CAST(l_suppkey % 10 AS INT)",
    "v024": "s_nationkey",
    "v005": "CAST(l_quantity AS BIGINT) * 100000 + 500000",
    "b19": "CAST((2001 - year(l_shipdate)) * 12 + 12 - month(l_shipdate) AS INT)",
    "m3a": (
        "CASE WHEN l_partkey % 17 = 0 THEN NULL "
        "WHEN l_partkey % 10 = 0 THEN CAST(l_linestatus = 'O' AS INT) "
        "ELSE CAST(CAST(l_quantity AS INT) % 12 + 2 * (l_linenumber % 3) >= 8 AS INT) END"
    ),
    "m3b": _ATTENDED.format("CAST(l_linenumber = 7 AS INT)"),
    "m3c": "CASE WHEN l_partkey % 17 = 0 OR l_partkey % 19 = 0 THEN NULL ELSE 0 END",
    "m3d": _ATTENDED.format("CAST(l_returnflag = 'R' AND l_linenumber = 6 AS INT)"),
    "m14": (
        "CASE WHEN l_partkey % 23 = 0 THEN 98 WHEN l_partkey % 29 = 0 THEN NULL "
        "ELSE CAST(l_quantity AS INT) % 12 END"
    ),
    "v467b": "CAST(l_linenumber % 3 AS INT)",
    "v467c": "CAST(l_partkey % 3 AS INT)",
    "v467d": "CAST((l_suppkey + l_linenumber) % 3 AS INT)",
    "v467f": "CAST(l_partkey % 2 AS INT)",
    "bord": "l_linenumber",
    "m10": "CAST(1 + l_partkey % 3 AS INT)",
    "v467a": "CAST(NULL AS INT)",
}
BIRTHS_FROM = "lineitem JOIN supplier ON l_suppkey = s_suppkey"

_PARTNERED = "CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE CAST({} AS INT) END"

WOMEN = {
    "caseid": "o_orderkey",
    "v001": "o_custkey",
    "v005": "CAST(0 AS BIGINT)",
    "v021": "o_custkey",
    "v022": "CAST(0 AS INT)",
    "v024": "CAST(0 AS INT)",
    "v012": "CAST(14 + o_custkey % 38 AS INT)",
    "v106": "CAST(substring(o_orderpriority, 1, 1) AS INT) - 1",
    "v501": "CAST(o_custkey % 6 AS INT)",
    "v511": _PARTNERED.format("14 + o_custkey % 15"),
    "v701": _PARTNERED.format("o_orderkey % 4"),
    "v705": _PARTNERED.format("o_orderkey % 9"),
    "v218": "CAST(o_orderkey % 7 AS INT)",
    "v212": "CAST(15 + o_orderkey % 20 AS INT)",
    "v190": (
        "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 "
        "WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END"
    ),
    "v025": "CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END",
    "v481": "CAST(o_orderkey % 2 AS INT)",
    "v157": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS INT) END",
    "v158": "CAST(o_custkey % 3 AS INT)",
    "v159": "CAST(o_custkey % 2 AS INT)",
    "v113": (
        "CASE o_orderkey % 5 WHEN 0 THEN 11 WHEN 1 THEN 21 WHEN 2 THEN 30 "
        "WHEN 3 THEN 43 ELSE 96 END"
    ),
    "v116": (
        "CASE o_custkey % 5 WHEN 0 THEN 11 WHEN 1 THEN 22 WHEN 2 THEN 23 "
        "WHEN 3 THEN 31 ELSE 42 END"
    ),
    "survey_year": "CASE WHEN year(o_orderdate) < 1998 THEN 2016 ELSE 2024 END",
}
WOMEN_FROM = "orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 31 <> 0"

CLUSTERS = {
    "DHSCLUST": "s_suppkey",
    "ADM1NAME": "CASE WHEN s_suppkey % 11 = 0 THEN 'NATION_0' ELSE ' ' || lower(n_name) || ' ' END",
    "ADM1DHS": "n_nationkey",
    "URBAN_RURA": "CASE WHEN s_suppkey % 3 = 0 THEN 'U' ELSE 'R' END",
}
CLUSTERS_FROM = "supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 37 <> 0"

REGION_LABELS = {
    "code": "n_nationkey",
    "region_name": "n_name",
    "region_stratum": (
        "CASE WHEN r_name IN ('AFRICA', 'MIDDLE EAST') THEN 'Pastoralist/Arid' "
        "WHEN r_name = 'EUROPE' THEN 'Urban/Peri-urban' ELSE 'Agrarian Highlands' END"
    ),
}
REGION_LABELS_FROM = "nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24"

FLAGGED_NATIONS = ("NATION_0", "NATION_7", "NATION_24", "NOWHERE")

ATTENDED_SQL = "m3a = 1 OR m3b = 1 OR m3d = 1"
SCORED_PROBA = (
    "((caseid * 3 + bidx * 7 + v021 * 13) % 61 "
    f"+ CASE WHEN {ATTENDED_SQL} THEN 40 ELSE 0 END) / 1e2"
)


def _select_list(view: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in view.items())


def _view(spark: SparkSession, sf_dir: str, tables: list[str], view: dict, source: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for table in tables:
        source = source.replace(table + " ", "{" + table + "} ", 1)
    return spark.sql(f"SELECT {_select_list(view)} FROM {source}", **frames)


def births(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ["lineitem", "supplier"], BIRTHS, BIRTHS_FROM)


def women(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ["orders", "customer"], WOMEN, WOMEN_FROM)


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ["supplier", "nation"], CLUSTERS, CLUSTERS_FROM)


def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ["nation", "region"], REGION_LABELS, REGION_LABELS_FROM)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome and a deterministic score with many ties, without fitting a model."""
    b = births(spark, sf_dir).filter("m3a IS NOT NULL").selectExpr(
        "caseid", "bidx", "v021", "v005 / 1e6 AS weight",
        f"CAST({ATTENDED_SQL} AS INT) AS y", f"{SCORED_PROBA} AS proba",
    )
    w = women(spark, sf_dir).select("caseid", "v190", "v025")
    return b.join(w, "caseid")


# --- The same views as DuckDB common table expressions ----------------------
DUCKDB_VIEWS = {
    "births": f"SELECT {_select_list(BIRTHS)} FROM {BIRTHS_FROM}",
    "women": f"SELECT {_select_list(WOMEN)} FROM {WOMEN_FROM}",
    "clusters": f"SELECT {_select_list(CLUSTERS)} FROM {CLUSTERS_FROM}",
    "region_labels": f"SELECT {_select_list(REGION_LABELS)} FROM {REGION_LABELS_FROM}",
    "scored": (
        "SELECT b.caseid, b.bidx, b.v021, b.v005 / 1e6 AS weight, w.v190, w.v025, "
        f"CAST({ATTENDED_SQL} AS INT) AS y, "
        f"{SCORED_PROBA.replace('caseid', 'b.caseid').replace('v021', 'b.v021')} AS proba "
        "FROM births b JOIN women w ON b.caseid = w.caseid WHERE b.m3a IS NOT NULL"
    ),
}
