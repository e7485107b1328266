"""DuckDB SQL for the metadata queries: the same results from the same Parquet tables, written apart."""

from __future__ import annotations

from quirewright.functions.geo import CANADIAN_CITIES, CANADIAN_PROVINCES, CITY_HINTS, FOREIGN_CITIES, STATE_HINTS, US_STATES
from quirewright.functions.text import CORPUS_STOP_WORDS, ENGLISH_STOP_WORDS, GENERIC_NAME_WORDS
from quirewright.operators.profiling import USABLE_FIELDS
from quirewright.schema import CLEAN_COLUMNS, LEXICON_CATEGORIES, TEXT_COLUMNS

WS = "[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"
MISSING = "('', 'nan', 'NaN', 'N/A', 'n/a', 'NA', 'None', 'none', 'null', 'NULL')"


def lits(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def mapped(table: dict[str, str], x: str, other: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def clean(c: str) -> str:
    return f"regexp_replace(trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g')), '^(nan|NaN|N/A|n/a|NA|None|none|null|NULL)$', '')"


def key(c: str) -> str:
    return f"trim(regexp_replace(replace(lower({clean(c)}), '&', ' and '), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def title_case(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || w[2:]), '')"


def publication_key(c: str) -> str:
    """Every word between blanks of its own, so that each pattern takes whole words away."""
    plain = f"trim(regexp_replace({clean(c)}, '\\([^)]*\\)', ' ', 'g'))"
    plain = f"regexp_replace({plain}, '^((?:online|fulltext|full text|pre[- ]?[0-9]{{4}}) +)*the +', '', 'i')"
    plain = f"regexp_replace({plain}, '[''’]s\\b', 's', 'gi')"
    x = f"(' ' || replace({key(plain)}, ' ', '  ') || ' ')"
    x = f"regexp_replace({x}, ' (pre(  )?[0-9]{{4}}|online|fulltext|full  text) ', '', 'g')"
    x = f"regexp_replace({x}, ' (inc|llc|ltd|corp|corporation|company|co) ', '', 'g')"
    x = f"trim(regexp_replace(replace({x}, ' u  s ', ' us '), ' +', ' ', 'g'))"
    return f"coalesce(nullif(regexp_replace({title_case(x)}, '\\bUs ', 'US ', 'g'), ''), 'Unknown')"


def items(c: str) -> str:
    quoted = (
        f"list_transform(regexp_extract_all({clean(c)}, '''(?:[^''\\\\]|\\\\.)*''|\"(?:[^\"\\\\]|\\\\.)*\"'), "
        f"lambda x: replace(replace(replace(x[2:-2], '\\''', ''''), '\\\"', '\"'), '\\x01', chr(1)))"
    )
    found = f"CASE WHEN {clean(c)} LIKE '[%]' THEN {quoted} ELSE string_split_regex({clean(c)}, ' *[;|] *') END"
    return f"list_filter(list_transform({found}, lambda x: {clean('x')}), lambda x: x <> '')"


def canonical(x: str) -> str:
    t = f"trim({clean(x)}, '''\"')"
    return f"CASE WHEN {t} = upper({t}) AND {t} <> lower({t}) THEN {title_case(t)} ELSE {t} END"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-z][A-Za-z''\\-]*'), lambda w: upper(replace(w, '-', '')))"


_NAMES = {"date": "date_text", "language": "language_name"}
_RAW = ", ".join(f"CASE WHEN {_NAMES.get(c, c)} NOT IN {MISSING} THEN {_NAMES.get(c, c)} END AS {c}" for c in TEXT_COLUMNS)
_DAY = f"""CASE
    WHEN regexp_full_match(dt, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime(dt, '%Y-%m-%d')
    WHEN regexp_full_match(dt, '[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}') THEN try_strptime(dt, '%Y/%m/%d')
    WHEN regexp_full_match(dt, '[0-9]{{8}}') THEN try_strptime(dt, '%Y%m%d')
    WHEN regexp_full_match(dt, '[A-Za-z]{{3}} [0-9]{{1,2}}, [0-9]{{4}}') THEN try_strptime(dt, '%b %d, %Y')
    WHEN regexp_full_match(dt, '[A-Za-z]+ [0-9]{{1,2}}, [0-9]{{4}}') THEN try_strptime(dt, '%B %d, %Y')
    WHEN regexp_full_match(dt, '[0-9]{{1,2}} [A-Za-z]{{3}} [0-9]{{4}}') THEN try_strptime(dt, '%d %b %Y')
    WHEN regexp_full_match(dt, '[0-9]{{1,2}} [A-Za-z]+ [0-9]{{4}}') THEN try_strptime(dt, '%d %B %Y')
    WHEN regexp_full_match(dt, '[0-9]{{4}}-[0-9]{{2}}') THEN try_strptime(dt || '-01', '%Y-%m-%d')
    WHEN regexp_full_match(dt, '[0-9]{{4}}') THEN try_strptime(dt || '-01-01', '%Y-%m-%d') END"""

#: All records with the derived columns, and the English ones.
BASE = f"""
WITH r0 AS (SELECT row_id, load_id, source_partition, {_RAW} FROM master),
r1 AS (SELECT *, {clean('date')} AS dt, {key("replace(" + clean('publisher_city') + ", '.', ' ')")} AS ck,
    {clean('publisher_city')} AS ct, upper({key('publisher_province')}) AS pk,
    {items('authors')} AS author_items, {items('subject_terms')} AS subject_items,
    {items('class_terms')} AS class_items, {items('company_name')} AS company_items FROM r0),
r2 AS (SELECT *, {_DAY} AS day0, coalesce(nullif(pk, ''), {mapped(STATE_HINTS, 'ck', "''")}) AS publisher_province_normalized,
    {mapped(CITY_HINTS, 'ck', title_case('ct'))} AS publisher_city_normalized FROM r1),
r AS (SELECT *, strftime(day, '%Y-%m-%d') AS publication_date, CAST(year(day) AS BIGINT) AS year, CAST(year(day) // 10 * 10 AS BIGINT) AS decade
    FROM (SELECT *, CASE WHEN year(day0) BETWEEN 1677 AND 2262 THEN day0 END AS day,
    CASE WHEN publisher_province_normalized IN ({lits(US_STATES)}) THEN 'United States'
        WHEN publisher_province_normalized IN ({lits(CANADIAN_PROVINCES)}) OR ck IN ({lits(CANADIAN_CITIES)}) THEN 'Canada'
        WHEN ck IN ({lits(FOREIGN_CITIES)}) THEN 'Non-US/Canada: ' || {mapped(FOREIGN_CITIES, 'ck', "''")}
        WHEN publisher_city_normalized <> '' THEN 'Unknown/Needs Review' ELSE 'Missing publisher location' END AS publisher_region,
    publisher_city_normalized || CASE WHEN publisher_province_normalized <> '' THEN ', ' || publisher_province_normalized ELSE '' END
        AS publisher_location_normalized,
    {key('title')} AS title_normalized, {publication_key('publication_title')} AS publication_title_normalized,
    CASE WHEN contains(source_partition, 'Trade') THEN 'trade_journals' WHEN contains(source_partition, 'Magazines') THEN 'magazines'
        ELSE 'newspapers' END AS partition_family,
    author_items[1] AS primary_author, CAST(len(author_items) AS SMALLINT) AS author_count,
    CAST(len(subject_items) AS SMALLINT) AS subject_term_count, CAST(len(class_items) AS SMALLINT) AS class_term_count,
    CAST(len(company_items) AS SMALLINT) AS company_count,
    CASE WHEN regexp_full_match(trim(pages), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trim(pages) AS DOUBLE) END AS pages_numeric,
    array_to_string(list_filter([{clean('title')}, array_to_string(subject_items[1:12], ' '), array_to_string(class_items[1:12], ' ')],
        lambda x: x <> ''), ' ') AS metadata_text
    FROM r2)),
r_display AS (SELECT *, coalesce(nullif(array_to_string(shown[CASE WHEN len(shown) > 1 AND lower(shown[1]) = 'the' THEN 2 ELSE 1 END:], ' '), ''),
    publication_title_normalized) AS publication_title_display
    FROM (SELECT *, regexp_extract_all(regexp_replace({clean('publication_title')}, '\\([^)]*\\)', ' ', 'g'), '[^ ]+') AS shown FROM r)),
e AS (SELECT * FROM r_display WHERE language = 'English'),
"""
BASE = BASE.rstrip().rstrip(",") + "\n"


def freq(source: str, dims: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, coalesce(CAST({c} AS VARCHAR), '<missing>') AS value, count(*) AS documents FROM {source} GROUP BY ALL" for d, c in dims.items()
    )


_NO_NULL_YEAR = "WHERE NOT (dimension IN ('year', 'decade') AND value = '<missing>')"
_TERMS = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, unnest(list_transform({c}, lambda t: {canonical('t')})) AS value FROM e"
    for d, c in (("subject_terms", "subject_items"), ("class_terms", "class_items"), ("authors", "author_items"))
)
_MISSING_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_rows, count(*) AS n FROM r" for c in TEXT_COLUMNS)
_AUTHORS = "count(*) AS documents, count(*) FILTER (author_count > 0) AS documents_with_author, CAST(sum(author_count) AS BIGINT) AS author_mentions"
_AUTHOR_SHARES = "round(documents_with_author / documents, 9) AS author_coverage_share, round(author_mentions / documents, 9) AS mean_author_mentions"
_BOUNDS = "min(publication_date) AS first_date, max(publication_date) AS last_date, count(*) FILTER (publication_date IS NULL) AS invalid_or_missing_dates"
_QUALITY = f"""SELECT source_partition, count(*) AS raw_rows, count(*) FILTER (language = 'English') AS english_rows, {_BOUNDS},
    round(count(*) FILTER (language = 'English') / count(*), 9) AS english_share FROM r GROUP BY source_partition"""
_MANIFEST = """(SELECT coalesce(r.source_partition, m.dataset_name) AS dataset_name, coalesce(r.load_id, m.load_id) AS load_id, document_count, records,
    coalesce(document_count = records, false) AS matches
    FROM (SELECT source_partition, load_id, count(*) AS records FROM master GROUP BY ALL) r
    FULL JOIN manifest m ON m.dataset_name = r.source_partition AND m.load_id = r.load_id)"""

_RULES = {
    "duplicate_goid": ("goid",),
    "duplicate_exact_title_date_publication": ("title", "date", "publication_title"),
    "duplicate_normalized_title_date_publication": ("title_normalized", "date", "publication_title_normalized"),
    "duplicate_title_date": ("title_normalized", "date"),
}


def _by(columns) -> str:
    return ", ".join(f"coalesce({c}, '')" for c in columns)


_DUPLICATES = " UNION ALL ".join(
    f"SELECT '{r}' AS duplicate_rule, CAST(sum(n - 1) AS BIGINT) AS duplicate_extra_rows, count(*) FILTER (n > 1) AS duplicate_groups, "
    f"round(sum(n - 1) / sum(n), 9) AS share_of_rows FROM (SELECT count(*) AS n FROM e GROUP BY {_by(c)})"
    for r, c in _RULES.items()
)
_FLAGS = ", ".join(f"count(*) OVER (PARTITION BY {_by(c)}) > 1 AS {r}" for r, c in _RULES.items())

_MEMBERS = " UNION ".join(f"SELECT upper(word) AS word, '{c}' AS category FROM lexicon WHERE {c} <> 0" for c in LEXICON_CATEGORIES)
_COUNTS = ", ".join(f"CAST(count(*) FILTER (category = '{c}') AS BIGINT) AS lm_{c}" for c in LEXICON_CATEGORIES)
_HITS = ", ".join(f"coalesce(lm_{c}, 0) AS lm_{c}" for c in LEXICON_CATEGORIES)
_SCORED = f""", members AS ({_MEMBERS}),
tk AS (SELECT row_id, year, decade, source_type, partition_family, metadata_text, {tokens('metadata_text')} AS tok FROM e),
hits AS (SELECT row_id, {_COUNTS} FROM (SELECT row_id, unnest(tok) AS word FROM tk) JOIN members USING (word) GROUP BY row_id),
sc AS (SELECT tk.*, CAST(len(tok) AS BIGINT) AS lm_token_count, {_HITS} FROM tk LEFT JOIN hits ON hits.row_id = tk.row_id),
s AS (SELECT *, (lm_positive - lm_negative) / greatest(lm_token_count, 1) AS lm_net_tone FROM sc)
"""
_SUM_RATES = ", ".join(f"round(sum(lm_{c}) / greatest(sum(lm_token_count), 1), 9) AS mean_{c}_rate" for c in ("positive", "negative", "uncertainty"))


def anova(group: str, value: str, source: str, digits: int) -> str:
    return f""", g AS (SELECT {group} AS k, count(*) AS n, avg({value}) AS m, var_samp({value}) AS s2 FROM {source}
    WHERE {group} IS NOT NULL AND {value} IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
o AS (SELECT sum(n * m) / sum(n) AS gm FROM g),
a AS (SELECT sum(n * (m - gm) * (m - gm)) AS ssb, sum((n - 1) * s2) AS ssw, count(*) - 1 AS dfb, sum(n) - count(*) AS dfw FROM g, o)
SELECT '{group}' AS source, round(ssb, {digits}) AS sum_sq, CAST(dfb AS BIGINT) AS df, round(ssb / dfb, {digits}) AS mean_sq,
    round((ssb / dfb) / (ssw / dfw), {digits}) AS f_stat, round(ssb / (ssb + ssw), {digits}) AS eta_squared FROM a
UNION ALL SELECT 'residual', round(ssw, {digits}), CAST(dfw AS BIGINT), round(ssw / dfw, {digits}), NULL, NULL FROM a"""


_FACETS = ("decade", "source_type", "partition_family")
_LONG = "SELECT * FROM {t} WHERE length(metadata_text) > 10"
_STOP = lits(sorted({w.upper().replace("-", "") for w in ENGLISH_STOP_WORDS + CORPUS_STOP_WORDS}))


def mode(c: str, name: str, rows: str) -> str:
    return (
        f"(SELECT p AS name, coalesce(v, '') AS v FROM (SELECT {name} AS p, {c} AS v, count(*) AS n FROM {rows} "
        f"WHERE {c} IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p ORDER BY n DESC, v) = 1)"
    )


def firsts(c: str, k: int, name: str, rows: str) -> str:
    return f"(SELECT {name} AS name, array_to_string(list_sort(list(DISTINCT {c}))[1:{k}], '; ') AS v FROM {rows} WHERE {c} IS NOT NULL GROUP BY 1)"


def media(table: str, name: str, rows: str) -> str:
    return f"""{table} AS (SELECT b.*, coalesce(d.v, '') AS display_publication_title, coalesce(nv.v, '') AS normalized_variants, coalesce(pi.v, '') AS publication_ids,
    coalesce(st.v, '') AS top_source_type, coalesce(pu.v, '') AS top_publisher, coalesce(re.v, '') AS top_publisher_region
FROM (SELECT {name} AS publication_title_canonical, count(*) AS documents, min(year) AS first_year, max(year) AS last_year,
    count(DISTINCT primary_author) AS unique_authors, round(avg(subject_term_count), 9) AS avg_subject_terms FROM {rows} GROUP BY 1) b
LEFT JOIN {mode('publication_title_display', name, rows)} d ON d.name = publication_title_canonical
LEFT JOIN {firsts('publication_title_normalized', 8, name, rows)} nv ON nv.name = publication_title_canonical
LEFT JOIN {firsts('publication_id', 5, name, rows)} pi ON pi.name = publication_title_canonical
LEFT JOIN {mode('source_type', name, rows)} st ON st.name = publication_title_canonical
LEFT JOIN {mode('publisher_name', name, rows)} pu ON pu.name = publication_title_canonical
LEFT JOIN {mode('publisher_region', name, rows)} re ON re.name = publication_title_canonical)
"""


_MEDIA = media("media", "publication_title_normalized", "e")
_EXAMPLES = " UNION ALL ".join(
    f"SELECT publication_title_normalized, '{c}' AS example_kind, {c} AS value, count(*) AS documents FROM e WHERE {c} <> '' GROUP BY ALL"
    for c in ("publication_title", "publication_id", "publisher_name", "source_type")
)
_NAME_TOKENS = "list_filter(string_split({k}, ' '), lambda w: w <> '')"


def anchors(c: str) -> str:
    words = f"list_distinct({_NAME_TOKENS.format(k=key(c))})"
    some = f"list_filter({words}, lambda w: w NOT IN ({lits(GENERIC_NAME_WORDS)}))"
    return f"CASE WHEN len({some}) = 0 THEN {words} ELSE {some} END"


def joined(x: str) -> str:
    return f"array_to_string(list_sort({x}), '; ')"


_ALIAS = f""", {_MEDIA}, n AS (SELECT publication_title_canonical AS name, documents, publication_ids, {clean('top_publisher')} AS pub,
    {anchors('publication_title_canonical')} AS a FROM media)
SELECT l.name AS "left", r.name AS "right",
    round(len(list_intersect(l.a, r.a)) / len(list_distinct(list_concat(l.a, r.a))), 9) AS token_overlap,
    {joined('list_intersect(l.a, r.a)')} AS shared_anchor_tokens,
    {joined('list_filter(l.a, lambda w: NOT list_contains(r.a, w))')} AS left_only_anchor_tokens,
    {joined('list_filter(r.a, lambda w: NOT list_contains(l.a, w))')} AS right_only_anchor_tokens,
    list_has_all(l.a, r.a) AND list_has_all(r.a, l.a) AS same_anchor_tokens,
    list_has_any(string_split(l.publication_ids, '; '), string_split(r.publication_ids, '; ')) AS shared_publication_id,
    l.pub = r.pub AND l.pub <> '' AS shared_top_publisher
FROM n l JOIN n r ON (l.documents > r.documents OR (l.documents = r.documents AND l.name < r.name))
    AND abs(length(l.name) - length(r.name)) <= 18
    AND ({key('l.name')} = {key('r.name')} OR (len(list_intersect(l.a, r.a)) > 1 AND (list_has_all(l.a, r.a) OR list_has_all(r.a, l.a))))"""

_DECIDED = f"""{_ALIAS.replace('SELECT l.name AS "left"', ', pairs AS (SELECT l.name AS "left"', 1)}),
d AS (SELECT *, {key('"left"')} = {key('"right"')} AS exact, shared_publication_id OR shared_top_publisher AS support,
    shared_anchor_tokens NOT LIKE '%; %' AS low FROM pairs),
decisions AS (SELECT "left" AS publication_left, "right" AS publication_right, CASE WHEN exact THEN 'auto-merge; exact normalized publication'
    WHEN same_anchor_tokens AND low THEN 'keep separate; low-information anchor tokens' WHEN same_anchor_tokens THEN 'auto-merge; same anchor tokens'
    WHEN low THEN 'keep separate; low-information subset anchors'
    WHEN shared_publication_id THEN 'auto-merge; subset anchor tokens with shared publication id'
    WHEN support AND token_overlap >= 0.6 THEN 'review; metadata-backed near match'
    WHEN token_overlap >= 0.75 THEN 'review; strong title overlap' ELSE 'keep separate; low evidence' END AS recommendation FROM d)"""
_EDGES = """edges AS (SELECT publication_left AS a, publication_right AS b FROM decisions WHERE starts_with(recommendation, 'auto-merge')
    UNION SELECT publication_right, publication_left FROM decisions WHERE starts_with(recommendation, 'auto-merge')),
reach AS (SELECT publication_title_canonical AS node, publication_title_canonical AS seen FROM media UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.seen),
mapping AS (SELECT node AS publication_title, seen AS canonical_title FROM reach JOIN media ON publication_title_canonical = seen
    QUALIFY row_number() OVER (PARTITION BY node ORDER BY documents DESC, length(seen), seen) = 1)"""
_MERGED = BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f"{_DECIDED}, {_EDGES}"
_WATCHED = f""", {_MEDIA}, o AS (SELECT *, {publication_key('publication_title_canonical')} AS publication_key,
    CAST(row_number() OVER (ORDER BY documents DESC, publication_title_canonical) AS INTEGER) AS corpus_rank FROM media),
w AS (SELECT *, {publication_key('reference_publication')} AS publication_key FROM watch_list),
wr AS (SELECT publication_key, reference_role AS role FROM w QUALIFY row_number() OVER (PARTITION BY publication_key ORDER BY reference_publication DESC) = 1),
b AS (SELECT o.publication_key, coalesce(nullif(display_publication_title, ''), publication_title_canonical) AS publication, documents, corpus_rank, first_year,
    last_year, top_source_type, role IS NOT NULL AS real_world_reference, coalesce(role, 'high-frequency title in corpus') AS reference_role,
    'top corpus frequency' AS why_included FROM o LEFT JOIN wr ON wr.publication_key = o.publication_key WHERE corpus_rank <= 35
    UNION ALL SELECT w.publication_key, coalesce(display_publication_title, reference_publication), documents, corpus_rank, first_year, last_year,
    top_source_type, true, reference_role, 'reference outlet' FROM w LEFT JOIN o ON o.publication_key = w.publication_key)
SELECT *, documents IS NOT NULL AS observed_in_corpus FROM b QUALIFY row_number() OVER (PARTITION BY publication_key ORDER BY
    documents IS NOT NULL DESC, documents DESC NULLS LAST, real_world_reference DESC, why_included DESC, corpus_rank, publication, reference_role) = 1"""

_GRAMS = f"""t AS (SELECT row_id, list_filter(regexp_extract_all(lower(metadata_text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{2,}}')
    AND x NOT IN ({lits(ENGLISH_STOP_WORDS + CORPUS_STOP_WORDS)})) AS w FROM e),
u AS (SELECT row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
f AS (SELECT row_id, term, count(*) AS tf FROM u GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term HAVING count(*) >= 10 AND count(*) <= 0.65 * (SELECT count(*) FROM e))"""
_TFIDF = f""", {_GRAMS},
x AS (SELECT row_id, term, tf * (ln((1 + (SELECT count(*) FROM e)) / (1 + df)) + 1) AS v FROM f JOIN d USING (term))
SELECT row_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY row_id)), 7) AS weight FROM x"""

_BREAKS = " + ".join(f"length(coalesce({_NAMES.get(c, c)}, '')) - length(replace(coalesce({_NAMES.get(c, c)}, ''), chr(10), ''))" for c in TEXT_COLUMNS)

def drawn(source: str, strata: str, k: str) -> str:
    lot = "md5(concat_ws('|', CAST(row_id AS VARCHAR), '42'))"
    return f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {strata} ORDER BY {lot}, row_id) <= {k})"


_TONE_BY_DECADE = """decade, count(*) AS documents, round(avg(lm_net_tone), 9) AS mean_net_tone, CAST(sum(lm_positive) AS BIGINT) AS positive_words,
    CAST(sum(lm_negative) AS BIGINT) AS negative_words, CAST(sum(lm_uncertainty) AS BIGINT) AS uncertainty_words, CAST(sum(lm_token_count) AS BIGINT) AS tokens"""

ORACLE = {
    "clean_keys": BASE + f"SELECT row_id, {clean('title')} AS title_clean, {key('title')} AS title_normalized FROM master",
    "publication_names": BASE + "SELECT row_id, publication_title_normalized, publication_title_display FROM r_display",
    "canonical_terms": BASE
    + f"""SELECT row_id, CAST(i - 1 AS INTEGER) AS pos, {canonical('term')} AS term, {title_case('term')} AS title_cased
FROM (SELECT row_id, subject_items[i] AS term, i FROM (SELECT row_id, subject_items, unnest(range(1, len(subject_items) + 1)) AS i FROM r))""",
    "list_fields": BASE
    + "SELECT row_id, primary_author, "
    + ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ("author_count", "subject_term_count", "class_term_count", "company_count"))
    + " FROM r",
    "metadata_texts": BASE + f"SELECT row_id, metadata_text, CAST(len({tokens('metadata_text')}) AS INTEGER) AS n_tokens, partition_family FROM r",
    "name_anchor_sets": BASE
    + f"""SELECT DISTINCT publication_title_normalized, {joined(_NAME_TOKENS.format(k=key('publication_title_normalized')))} AS tokens,
    {joined(anchors('publication_title_normalized'))} AS anchors FROM r""",
    "publisher_locations": BASE
    + "SELECT row_id, publisher_city_normalized, publisher_province_normalized, publisher_region, publisher_location_normalized FROM r",
    "dates_and_pages": BASE + "SELECT row_id, publication_date, year, decade, pages_numeric FROM r",
    "clean_table": BASE + f"SELECT row_id, {', '.join(CLEAN_COLUMNS)} FROM e",
    "missing_profile": BASE + f"SELECT column_name, missing_rows, round(missing_rows / n, 9) AS missing_share FROM ({_MISSING_ROWS})",
    "usable_fields": BASE
    + f"""SELECT column_name, round(1 - missing_rows / n, 9) AS nonmissing_share, missing_rows, round(missing_rows / n, 9) AS missing_share
FROM ({_MISSING_ROWS}) WHERE column_name IN ({lits(USABLE_FIELDS)})""",
    "row_counts": BASE
    + "SELECT source_partition, count(*) AS raw_rows, count(*) FILTER (language = 'English') AS english_rows FROM r GROUP BY source_partition",
    "file_validation": f"""
WITH f AS (SELECT source_partition, count(*) + CAST(sum({_BREAKS}) AS BIGINT) AS master_rows FROM master GROUP BY 1),
m AS (SELECT dataset_name, CAST(sum(document_count) AS BIGINT) AS manifest_rows FROM manifest GROUP BY 1)
SELECT source_partition, manifest_rows, master_rows, CAST(31 AS INTEGER) AS master_columns, true AS schema_matches,
    coalesce(manifest_rows = master_rows, false) AS manifest_rows_match, false AS extended_rows_match
FROM f LEFT JOIN m ON m.dataset_name = source_partition""",
    "scanned_partitions": """
SELECT source_partition, count(*) AS records, count(DISTINCT nullif(goid, '')) AS goids, count(DISTINCT nullif(title, '')) AS titles,
    count(DISTINCT nullif(subject_terms, '')) AS subjects FROM master GROUP BY 1""",
    "date_bounds": BASE + f"SELECT {_BOUNDS} FROM r",
    "partition_quality": BASE + _QUALITY,
    "manifest_check": f"SELECT * FROM {_MANIFEST}",
    "partition_quality_checked": BASE
    + f"""SELECT q.*, manifest_rows, loads_off FROM ({_QUALITY}) q LEFT JOIN (SELECT dataset_name, CAST(sum(document_count) AS BIGINT) AS manifest_rows,
    count(*) FILTER (NOT matches) AS loads_off FROM {_MANIFEST} GROUP BY 1) v ON v.dataset_name = q.source_partition""",
    "frequencies_all": BASE
    + freq("r", {"source_type": "source_type", "language": "language", "object_type": "object_type", "publisher_region": "publisher_region",
                 "publisher_location": "publisher_location_normalized", "source_partition": "source_partition"}),
    "frequencies_english": BASE
    + f"SELECT * FROM ({freq('e', {'publication': 'publication_title', 'publication_normalized': 'publication_title_normalized', 'year': 'year', 'decade': 'decade'})}) {_NO_NULL_YEAR}",
    "final_counts": BASE
    + f"SELECT * FROM ({freq('e', {c: c for c in ('source_type', 'object_type', 'publisher_region', 'year', 'decade')})}) {_NO_NULL_YEAR}",
    "term_frequencies": BASE + f"SELECT dimension, value, count(*) AS documents FROM ({_TERMS}) WHERE value <> '' GROUP BY ALL",
    "top_subject_terms": BASE
    + f"""SELECT value, count(*) AS documents FROM ({_TERMS}) WHERE value <> '' AND dimension = 'subject_terms'
GROUP BY ALL ORDER BY documents DESC, value LIMIT 1000""",
    "page_statistics": BASE
    + """SELECT count(pages_numeric) AS n, round(avg(pages_numeric), 6) AS mean_pages, round(stddev_pop(pages_numeric), 6) AS sd_pages,
    min(pages_numeric) AS min_pages, max(pages_numeric) AS max_pages FROM e""",
    "core_summary": BASE
    + """, c AS (SELECT CAST(count(*) AS VARCHAR) AS raw_documents, CAST(count(*) FILTER (language = 'English') AS VARCHAR) AS english_documents,
    min(publication_date) AS time_range_start, max(publication_date) AS time_range_end,
    CAST(count(*) FILTER (publication_date IS NULL) AS VARCHAR) AS invalid_or_missing_dates,
    CAST(count(DISTINCT coalesce(source_type, '<missing>')) AS VARCHAR) AS source_type_count,
    CAST(count(DISTINCT publication_title_normalized) FILTER (language = 'English') AS VARCHAR) AS normalized_publications,
    (SELECT CAST(sum(least(n, 1200)) AS VARCHAR) FROM (SELECT count(*) AS n FROM e WHERE length(metadata_text) > 5 GROUP BY decade, source_type)) AS topic_sample_rows,
    'lexicon.parquet' AS lexicon_source FROM r)
UNPIVOT c ON COLUMNS(*) INTO NAME metric VALUE value""",
    "coverage_metrics": BASE
    + """, c AS (SELECT CAST(count(*) AS VARCHAR) AS raw_rows, CAST(count(*) FILTER (language = 'English') AS VARCHAR) AS english_rows,
    min(publication_date) AS first_observed_date, max(publication_date) AS last_observed_date,
    CAST(count(*) FILTER (publication_date IS NULL) AS VARCHAR) AS invalid_or_missing_dates,
    CAST(round(count(*) FILTER (language = 'English') / count(*), 6) AS VARCHAR) AS english_share FROM r)
UNPIVOT c ON COLUMNS(*) INTO NAME metric VALUE value""",
    "author_coverage": BASE + f"SELECT *, {_AUTHOR_SHARES} FROM (SELECT decade, {_AUTHORS} FROM e WHERE decade IS NOT NULL GROUP BY decade)",
    "author_coverage_by_source": BASE
    + f"SELECT *, {_AUTHOR_SHARES} FROM (SELECT decade, coalesce(source_type, '<missing>') AS source_type, {_AUTHORS} FROM e WHERE decade IS NOT NULL GROUP BY ALL)",
    "author_coverage_since_2000": BASE
    + f"SELECT *, {_AUTHOR_SHARES} FROM (SELECT coalesce(source_type, '<missing>') AS source_type, {_AUTHORS} FROM e WHERE decade >= 2000 GROUP BY ALL)",
    "metadata_depth": BASE
    + """SELECT decade, count(*) AS documents, round(avg(CAST(coalesce(length(subject_terms), 0) > 0 AS INTEGER)), 6) AS subject_term_coverage,
    round(avg(CAST(coalesce(length(class_terms), 0) > 0 AS INTEGER)), 6) AS class_term_coverage, round(avg(length(metadata_text)), 6) AS mean_text_length
FROM e WHERE decade IS NOT NULL GROUP BY decade""",
    "duplicate_summary": BASE + _DUPLICATES,
    "duplicate_flags": BASE
    + f"""SELECT row_id, {_FLAGS}, row_number() OVER (PARTITION BY {_by(_RULES['duplicate_normalized_title_date_publication'])}
    ORDER BY source_partition, row_id) > 1 AS is_conservative_duplicate_extra FROM e""",
    "stratum_sizes": BASE
    + "SELECT decade, source_type, least(count(*), 1200) AS documents FROM e WHERE length(metadata_text) > 5 GROUP BY ALL",
    "capped_sample": BASE
    + f""", l AS (SELECT row_id, decade, source_type, partition_family FROM e WHERE length(metadata_text) > 10 AND decade IS NOT NULL),
c AS (SELECT greatest(15000 // greatest(count(*), 1), 1) AS cap FROM (SELECT DISTINCT decade, source_type, partition_family FROM l))
SELECT * FROM {drawn('l', 'decade, source_type, partition_family', '(SELECT cap FROM c)')} ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '43')), row_id LIMIT 15000""",
    "sampled_tone": BASE + _SCORED + f"SELECT {_TONE_BY_DECADE} FROM {drawn('(SELECT * FROM s WHERE decade IS NOT NULL)', 'decade, source_type', '1200')} GROUP BY decade",
    "topic_totals": BASE
    + """, t AS (SELECT decade, coalesce(source_type, '<missing>') AS source_type, length(metadata_text) > 0 AS texted, length(coalesce(title, '')) > 0 AS titled FROM e)
SELECT decade, source_type, count(*) AS documents, count(*) FILTER (texted) AS with_topic, count(*) FILTER (titled) AS with_title_topic FROM t GROUP BY ALL""",
    "lexicon_lookup": f"SELECT word, array_to_string(list_sort(list(category)), ',') AS categories FROM ({_MEMBERS}) GROUP BY word",
    "lexicon_scores": BASE
    + _SCORED
    + "SELECT row_id, lm_token_count, "
    + ", ".join(f"lm_{c}, round(lm_{c} / greatest(lm_token_count, 1), 9) AS lm_{c}_rate" for c in LEXICON_CATEGORIES)
    + ", round(lm_net_tone, 9) AS lm_net_tone FROM s",
    "tone_by_decade_and_source": BASE
    + _SCORED
    + f"SELECT decade, source_type, count(*) AS documents, round(avg(lm_net_tone), 9) AS mean_net_tone, {_SUM_RATES} FROM s GROUP BY ALL",
    "tone_by_decade": BASE
    + _SCORED
    + f"SELECT {_TONE_BY_DECADE} FROM s GROUP BY decade",
    "tone_anova": BASE + _SCORED + anova("source_type", "lm_net_tone", "(SELECT * FROM s WHERE year >= 2000 AND lm_token_count > 0)", 7),
    "tone_group_statistics": BASE
    + _SCORED
    + """SELECT source_type, count(*) AS documents, round(avg(lm_net_tone), 9) AS mean_value, round(stddev_samp(lm_net_tone), 9) AS sd_value
FROM s WHERE year >= 2000 AND lm_token_count > 0 AND source_type IS NOT NULL GROUP BY 1 HAVING count(*) >= 30""",
    "pages_anova": BASE + anova("object_type", "pages_numeric", "e", 4),
    "group_sizes": BASE
    + ", l AS ("
    + _LONG.format(t="e")
    + ") "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS facet, {x} AS group_value, count(*) AS documents FROM l WHERE {x} IS NOT NULL GROUP BY ALL"
        for f, x in (("decade", "CAST(decade AS VARCHAR)"), ("source_type", "coalesce(source_type, '<missing>')"), ("partition_family", "partition_family"))
    ),
    "group_terms": BASE
    + f""", l AS (SELECT *, list_transform(list_filter({tokens('metadata_text')}, lambda w: length(w) > 2 AND w NOT IN ({_STOP})), lambda w: lower(w)) AS tt
    FROM e WHERE length(metadata_text) > 10), g AS ({' UNION ALL '.join(f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS group_value, unnest(tt) AS term FROM l WHERE {f} IS NOT NULL" for f in _FACETS)}),
c AS (SELECT facet, group_value, term, count(*) AS documents FROM g GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY facet, group_value ORDER BY documents DESC, term) AS INTEGER) AS rank FROM c QUALIFY rank <= 120""",
    "group_lexicon_totals": BASE
    + _SCORED
    + " UNION ALL ".join(
        f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS group_value, count(*) AS documents, CAST(sum(lm_token_count) AS BIGINT) AS lm_token_count, "
        + ", ".join(f"CAST(sum(lm_{c}) AS BIGINT) AS lm_{c}" for c in LEXICON_CATEGORIES)
        + f" FROM s WHERE length(metadata_text) > 10 AND {f} IS NOT NULL GROUP BY ALL"
        for f in _FACETS
    ),
    "object_type_by_decade_share": BASE
    + """, c AS (SELECT coalesce(object_type, '<missing>') AS object_type, 'share_' || decade AS decade, count(*) AS n FROM e WHERE decade IS NOT NULL GROUP BY ALL),
h AS (SELECT object_type, decade, round(n / sum(n) OVER (PARTITION BY decade), 9) AS share FROM c)
PIVOT h ON decade USING coalesce(sum(share), 0) GROUP BY object_type""",
    "media_summary": BASE + ", " + _MEDIA + "SELECT * FROM media",
    "publication_examples": BASE
    + f""", x AS ({_EXAMPLES})
SELECT *, CAST(row_number() OVER (PARTITION BY publication_title_normalized, example_kind ORDER BY documents DESC, value) AS INTEGER) AS rank FROM x QUALIFY rank <= 3""",
    "alias_pairs": BASE + _ALIAS,
    "alias_decisions": BASE
    + _DECIDED
    + """SELECT *, starts_with(recommendation, 'auto-merge') AS auto_merge, starts_with(recommendation, 'review') AS needs_review FROM decisions""",
    "canonical_names_by_words": _MERGED + "SELECT * FROM mapping",
    "canonical_rollup_by_words": _MERGED
    + """SELECT canonical_title, CAST(sum(documents) AS BIGINT) AS english_documents, first(display_publication_title ORDER BY documents DESC, publication_title) AS display_publication_title,
    array_to_string(list_sort(list(DISTINCT publication_title))[1:5], '; ') AS normalized_variants
FROM mapping JOIN media ON publication_title_canonical = publication_title GROUP BY 1""",
    "canonical_media_by_words": _MERGED
    + f", ec AS (SELECT e.*, canonical_title FROM e JOIN mapping ON mapping.publication_title = publication_title_normalized), {media('merged', 'canonical_title', 'ec')} SELECT * FROM merged",
    "canonical_components": BASE.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, p AS (SELECT DISTINCT publication_id, publication_title_normalized AS name FROM e WHERE publication_id IS NOT NULL),
c AS (SELECT name AS node, name AS seen FROM p UNION SELECT c.node, b.name FROM c JOIN p a ON a.name = c.seen JOIN p b ON b.publication_id = a.publication_id)
SELECT node, min(seen) AS component FROM c GROUP BY node""",
    "watched_publications": BASE + _WATCHED,
    "unobserved_publications": BASE
    + f""", o AS (SELECT DISTINCT {publication_key('publication_title_normalized')} AS k FROM e)
SELECT reference_publication, reference_role, expected_in_scope FROM watch_list
WHERE expected_in_scope AND {publication_key('reference_publication')} NOT IN (SELECT k FROM o)""",
    "tfidf_vectors": BASE + _TFIDF,
}
