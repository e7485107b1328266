"""Queries of the general data problems over the metadata tables, with DuckDB SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewright.operators.packed import PACKED_FIELDS, packed_arrays, packed_rows
from quirewright.operators.rejects import line_rejects, loaded_lines, value_rejects
from quirewright.operators.value_profile import ValueCounts, compared, findings, value_deltas
from quirewright.plans import packed_sql as ps
from quirewright.schema import TEXT_COLUMNS
from quirewright.session import new_path, written
from quirewright.sources.tables import table

PROFILED = ("company_name", "authors", "language_name", "degree")
SHIFTED = ("degree", "language_name")
#: The load that ``p6_withdrawn`` takes back.
WITHDRAWN = 3


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return packed_rows(table(spark, folder, "master"), PACKED_FIELDS, ["row_id"], min_items=2)


def p5_item_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many records hold how many items, by field."""
    arrays = packed_arrays(table(spark, folder, "master"), PACKED_FIELDS)
    return arrays.groupBy("field_name", F.size("field_items").alias("n_items")).agg(F.count(F.lit(1)).alias("records"))


def delivered_store(spark: SparkSession, folder: str) -> ValueCounts:
    """Counts that stand after every load was delivered in its turn; the records are read once for all of them."""
    store = ValueCounts(spark, new_path(spark, "value_counts"))
    deltas = written(value_deltas(table(spark, folder, "master"), PROFILED, "load_id"), "deltas", ["load_id"])
    for (load,) in deltas.select("load_id").distinct().orderBy("load_id").collect():  # a row per load
        store.apply(deltas.where(F.col("load_id").eqNullSafe(load)))
    return store


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return findings(delivered_store(spark, folder).counts(), SHIFTED)


def p6_profile(spark: SparkSession, folder: str) -> DataFrame:
    out = compared(delivered_store(spark, folder).counts(), SHIFTED).drop("n_rows_before")
    digits = ("missing_share", "distinct_ratio", "broken_share", "entropy", "missing_share_before", "distinct_ratio_before", "entropy_before", "shift")
    return out.withColumns({c: F.round(c, 6) for c in digits})


def p6_withdrawn(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and entropy after a load is taken back from the standing counts and its successor is compared anew."""
    store = delivered_store(spark, folder)
    store.apply(value_deltas(table(spark, folder, "master").where(F.col("load_id") == WITHDRAWN), PROFILED, "load_id", -1))
    out = compared(store.counts(), SHIFTED)
    return out.select("load_id", "column_name", "n_rows", "n_missing", "n_distinct", F.round("entropy", 6).alias("entropy"), F.round("shift", 6).alias("shift"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    values = value_rejects(table(spark, folder, "master"), "row_id", "goid", "date_text", "pages")
    lines = line_rejects(table(spark, folder, "raw_master"), "record_id", "raw_line")
    return values.select(F.lit("master").alias("origin"), "record_id", "reason").union(
        lines.select(F.lit("raw_master").alias("origin"), "record_id", "reason")
    )


def p7_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The valid records of the later delivery, with typed columns (the date shown as text)."""
    loaded = loaded_lines(table(spark, folder, "raw_master"), "record_id", "raw_line")
    return loaded.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


QUERIES = {
    "p5_found": p5_found,
    "p5_item_counts": p5_item_counts,
    "p6_found": p6_found,
    "p6_profile": p6_profile,
    "p6_withdrawn": p6_withdrawn,
    "p7_found": p7_found,
    "p7_loaded": p7_loaded,
}

_ITEMS = " UNION ALL ".join(f"SELECT row_id, '{f}' AS field_name, {ps.item_list(f)} AS x FROM master" for f in PACKED_FIELDS)

_VALUES = " UNION ALL ".join(
    f"SELECT load_id, '{c}' AS column_name, CASE WHEN {ps.present(c)} THEN {ps.folded(c)} END AS v FROM master" for c in PROFILED
)

_PROFILE = f"""
WITH t AS ({_VALUES}),
c AS (SELECT load_id, column_name, v, count(*) AS n FROM t GROUP BY ALL),
p AS (SELECT load_id, column_name, CAST(sum(n) AS BIGINT) AS n_rows,
        CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS n_missing, count(v) AS n_distinct,
        min(v) AS min_value, max(v) AS max_value,
        CAST(min(length(v)) AS INTEGER) AS min_length, CAST(max(length(v)) AS INTEGER) AS max_length,
        CAST(coalesce(sum(n) FILTER (regexp_matches(v, '[\\x{{FFFD}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')
            OR NOT regexp_matches(v, '\\p{{L}}')), 0) AS BIGINT) AS n_broken,
        first(v ORDER BY n DESC, v) FILTER (v IS NOT NULL) AS top_value, max(n) FILTER (v IS NOT NULL) AS top_count,
        sum(n * log2(n)) FILTER (v IS NOT NULL) AS nlogn
    FROM c GROUP BY ALL),
q AS (SELECT *, n_missing / n_rows AS missing_share, n_distinct / nullif(n_rows - n_missing, 0) AS distinct_ratio,
        n_broken / nullif(n_rows - n_missing, 0) AS broken_share,
        log2(nullif(n_rows - n_missing, 0)) - nlogn / nullif(n_rows - n_missing, 0) AS entropy FROM p),
b AS (SELECT *, lag(n_rows) OVER w AS n_rows_before, lag(missing_share) OVER w AS missing_share_before,
        lag(distinct_ratio) OVER w AS distinct_ratio_before, lag(entropy) OVER w AS entropy_before,
        lag(load_id) OVER w AS prev, lag(n_rows - n_missing) OVER w AS here_before
    FROM q WINDOW w AS (PARTITION BY column_name ORDER BY load_id)),
s AS (SELECT load_id, column_name, sum(abs(d)) / 2 AS shift FROM (
        SELECT load_id, column_name, v, sum(share) AS d FROM (
            SELECT b.load_id, b.column_name, c.v, c.n / (b.n_rows - b.n_missing) AS share
            FROM b JOIN c ON c.load_id = b.load_id AND c.column_name = b.column_name AND c.v IS NOT NULL
            UNION ALL SELECT b.load_id, b.column_name, c.v, -c.n / b.here_before
            FROM b JOIN c ON c.load_id = b.prev AND c.column_name = b.column_name AND c.v IS NOT NULL)
        GROUP BY ALL) GROUP BY ALL),
f AS (SELECT b.*, CASE WHEN prev IS NOT NULL AND n_rows > n_missing AND here_before > 0
        AND column_name IN ('degree', 'language_name') THEN shift END AS shift
    FROM b LEFT JOIN s USING (load_id, column_name))
"""

_DATE_TOKENS = "lower(trim(regexp_replace(d, '[^\\p{L}\\p{N}]+', ' ', 'g')))"
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
_REJECTS = f"""
WITH l AS (SELECT record_id, raw_line,
        regexp_full_match(raw_line, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS ok,
        regexp_extract_all(',' || raw_line, ',("(?:[^"]|"")*"|[^",]*)', 1) AS f FROM raw_master),
v AS (SELECT 'master' AS origin, row_id AS record_id, goid AS g, date_text AS d, pages AS p FROM master
    UNION ALL SELECT 'raw_master', record_id, trim(f[1], '"'), trim(f[3], '"'), trim(f[15], '"') FROM l WHERE ok AND len(f) = 31),
k AS (SELECT origin, record_id, trim(g, {ps.BLANKS}) AS g, d, {_DATE_TOKENS} AS k, p FROM v),
t AS (SELECT *, CASE WHEN regexp_full_match(k, '[0-9]{{4}} [0-9]{{2}} [0-9]{{2}}') THEN try_strptime(k, '%Y %m %d')
        WHEN regexp_full_match(k, '[0-9]{{8}}') THEN try_strptime(k, '%Y%m%d')
        WHEN regexp_full_match(k, '[0-9]{{4}}') THEN try_strptime(k, '%Y')
        WHEN regexp_full_match(k, '({_MONTHS}) [0-9]{{1,2}} [0-9]{{4}}')
        THEN coalesce(try_strptime(k, '%B %d %Y'), try_strptime(k, '%b %d %Y')) END AS day FROM k)
SELECT 'raw_master' AS origin, record_id, CASE WHEN ok THEN 'column_count' ELSE 'quoting' END AS reason
    FROM l WHERE NOT ok OR len(f) <> 31
UNION ALL SELECT origin, record_id, 'goid' FROM t WHERE g IS NULL OR NOT regexp_full_match(g, '[0-9]{{8,10}}')
UNION ALL SELECT origin, record_id, 'date' FROM t WHERE {ps.present('d')} AND (day IS NULL OR year(day) NOT BETWEEN 1850 AND 2026)
UNION ALL SELECT origin, record_id, 'pages' FROM t
    WHERE {ps.present('p')} AND NOT regexp_full_match(trim(p, {ps.BLANKS}), '[0-9]+([.][0-9]+)?([eE][0-9]+)?')
"""


def _field(k: int) -> str:
    return f"CASE WHEN f[{k}] LIKE '\"%' THEN replace(f[{k}][2:-2], '\"\"', '\"') ELSE f[{k}] END"


_OTHER = ", ".join(f"nullif({_field(k)}, '') AS {c}" for k, c in enumerate(TEXT_COLUMNS, 1) if c not in ("goid", "date", "pages"))
_LOADED = f"""
WITH l AS (SELECT record_id, regexp_extract_all(',' || raw_line, ',("(?:[^"]|"")*"|[^",]*)', 1) AS f FROM raw_master
    WHERE regexp_full_match(raw_line, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')),
v AS (SELECT *, trim({_field(1)}, {ps.BLANKS}) AS g, {_field(3)} AS d, {_field(15)} AS p FROM l WHERE len(f) = 31),
k AS (SELECT *, {_DATE_TOKENS} AS k FROM v),
t AS (SELECT *, CASE WHEN regexp_full_match(k, '[0-9]{{4}} [0-9]{{2}} [0-9]{{2}}') THEN try_strptime(k, '%Y %m %d')
        WHEN regexp_full_match(k, '[0-9]{{8}}') THEN try_strptime(k, '%Y%m%d')
        WHEN regexp_full_match(k, '[0-9]{{4}}') THEN try_strptime(k, '%Y')
        WHEN regexp_full_match(k, '({_MONTHS}) [0-9]{{1,2}} [0-9]{{4}}')
        THEN coalesce(try_strptime(k, '%B %d %Y'), try_strptime(k, '%b %d %Y')) END AS day FROM k)
SELECT record_id, CAST(g AS BIGINT) AS goid, CASE WHEN {ps.present('d')} THEN strftime(day, '%Y-%m-%d') END AS date,
    CASE WHEN {ps.present('p')} THEN TRY_CAST(trim(p, {ps.BLANKS}) AS DOUBLE) END AS pages, {_OTHER} FROM t
WHERE regexp_full_match(g, '[0-9]{{8,10}}') AND (NOT {ps.present('d')} OR (day IS NOT NULL AND year(day) BETWEEN 1850 AND 2026))
    AND (NOT {ps.present('p')} OR regexp_full_match(trim(p, {ps.BLANKS}), '[0-9]+([.][0-9]+)?([eE][0-9]+)?'))
"""

ORACLE = {
    "p5_found": f"""
WITH t AS ({_ITEMS})
SELECT row_id, field_name, CAST(i AS INTEGER) AS item_pos, x[i] AS item
FROM (SELECT row_id, field_name, x, unnest(range(1, len(x) + 1)) AS i FROM t WHERE len(x) >= 2)""",
    "p5_item_counts": f"""
WITH t AS ({_ITEMS}) SELECT field_name, CAST(len(x) AS INTEGER) AS n_items, count(*) AS records FROM t GROUP BY ALL""",
    "p6_found": _PROFILE
    + """SELECT load_id, column_name, 'pattern' AS finding FROM f WHERE broken_share > 0.05
UNION ALL SELECT load_id, column_name, 'missing' FROM f WHERE abs(missing_share - missing_share_before) > 0.10
UNION ALL SELECT load_id, column_name, 'distinct' FROM f WHERE distinct_ratio < 0.5 * distinct_ratio_before
UNION ALL SELECT load_id, column_name, 'shift' FROM f WHERE shift > 0.25""",
    "p6_profile": _PROFILE
    + """SELECT load_id, column_name, n_rows, n_missing, round(missing_share, 6) AS missing_share, n_distinct,
    round(distinct_ratio, 6) AS distinct_ratio, min_value, max_value, min_length, max_length, n_broken,
    round(broken_share, 6) AS broken_share, top_value, top_count, round(entropy, 6) AS entropy,
    round(missing_share_before, 6) AS missing_share_before, round(distinct_ratio_before, 6) AS distinct_ratio_before,
    round(entropy_before, 6) AS entropy_before, round(shift, 6) AS shift FROM f""",
    "p6_withdrawn": _PROFILE.replace("FROM master", f"FROM (SELECT * FROM master WHERE load_id IS DISTINCT FROM {WITHDRAWN})")
    + "SELECT load_id, column_name, n_rows, n_missing, n_distinct, round(entropy, 6) AS entropy, round(shift, 6) AS shift FROM f",
    "p7_found": _REJECTS,
    "p7_loaded": _LOADED,
}
