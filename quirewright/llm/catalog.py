"""Queries of the training-data operators, by name, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewright.functions.packed import folded, is_missing
from quirewright.llm import copies, frequent, leakage, mixture, places, spans, terms
from quirewright.operators.packed import packed_rows
from quirewright.plans import packed_sql as ps
from quirewright.sources.tables import table

COPY_COLUMNS = ("title", "date_text", "publication_title")
TERM_FIELDS = ["subject_terms", "class_terms"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copy_links(table(spark, folder, "master"), COPY_COLUMNS, "row_id", "load_id")


def p1_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """One record of each group with its number of copies."""
    return copies.collapsed(table(spark, folder, "master"), COPY_COLUMNS, "row_id", "load_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    marked = terms.marked_terms(table(spark, folder, "master"), TERM_FIELDS, "row_id")
    return marked.where("mark IS NOT NULL").select("field_name", "term", "mark")


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    marked = terms.marked_terms(table(spark, folder, "master"), TERM_FIELDS, "row_id")
    return marked.withColumns({"share": F.round("share", 9), "mark": F.coalesce("mark", F.lit("-"))})


def named_items(spark: SparkSession, folder: str) -> DataFrame:
    master = table(spark, folder, "master")
    title = F.col("publication_title")
    titles = master.where(~is_missing(title)).select(F.lit("publication_title").alias("field_name"), folded(title).alias("item"))
    authors = packed_rows(master, ["authors"]).select("field_name", folded(F.col("item")).alias("item"))
    return frequent.hashed(titles.union(authors))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequent.items_above(named_items(spark, folder), 0.005).select("field_name", "item")


def p3_top(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 most frequent items of each field with their counts."""
    return frequent.top_items(named_items(spark, folder), 50)


#: Usual short forms of a city's first word and of a province, and words around a city's name.
FIRST_WORDS = "saint=st sainte=ste fort=ft mount=mt port=pt north=n north=no south=s south=so east=e west=w"
PROVINCES = (
    "AL=ala AZ=ariz AR=ark CA=calif CA=cal CO=colo CT=conn DE=del DC=d.c FL=fla IL=ill IL=ills IN=ind KS=kans KS=kan MA=mass MI=mich "
    "MN=minn MS=miss MT=mont NE=nebr NE=neb NV=nev NH=n.h NJ=n.j NM=n.mex NY=n.y NC=n.c ND=n.dak OH=o OK=okla OR=ore OR=oreg PA=penna "
    "PA=penn RI=r.i SC=s.c SD=s.dak TN=tenn TX=tex VT=vt WA=wash WV=w.va WI=wis WI=wisc WY=wyo AB=alta BC=b.c MB=man NB=n.b NS=n.s "
    "ON=ont PE=p.e.i QC=que QC=p.q SK=sask"
)
AROUND = {
    places.COUNTRY: ("u.s.a", "usa", "u.s", "united states", "canada"),
    places.BEFORE: ("city of", "town of", "downtown", "greater", "near", "nr"),
    places.AFTER: ("city office", "head office", "office", "publ", "publishers"),
}


def place_aliases(spark: SparkSession) -> DataFrame:
    """Aliases for the places of ``place_reference``; any other table of this form will do."""
    rows = [(kind, *pair.split("=")) for kind, pairs in ((places.WORD, FIRST_WORDS), (places.PROVINCE, PROVINCES)) for pair in pairs.split()]
    rows += [(kind, "", phrase) for kind, phrases in AROUND.items() for phrase in phrases]
    return spark.createDataFrame(rows, places.ALIAS_SCHEMA)


def mapped(spark: SparkSession, folder: str) -> DataFrame:
    reference = table(spark, folder, "place_reference")
    return places.mapped_places(table(spark, folder, "master"), reference, place_aliases(spark), "row_id", "publisher_city", "publisher_province")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return mapped(spark, folder).select("row_id", "place_id")


def p4_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """All entries within the distance of each typed city, by name alone."""
    return places.candidates(table(spark, folder, "master"), table(spark, folder, "place_reference"), place_aliases(spark), "publisher_city")


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The typed places that have no entry, with how many records hold them."""
    return places.unmatched_values(mapped(spark, folder))


def leaks(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items")
    return leakage.leaked(table(spark, folder, "documents"), "doc_id", "text", items, "item_id", "item_text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(spark, folder).select("item_id", "doc_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it and the longest shared run."""
    return leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("shared_words").alias("longest_run"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    _, report = mixture.half_mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    return report.where("falls_short").select("source")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix itself."""
    mix, _ = mixture.half_mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    return mix


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares actually reached."""
    return mixture.half_mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_runs(table(spark, folder, "documents"), "doc_id", "text").select("doc_id").distinct()


def p10_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches that stand in other documents too."""
    return spans.shared_spans(spans.shared_runs(table(spark, folder, "documents"), "doc_id", "text"))


def p10_shared(spark: SparkSession, folder: str) -> DataFrame:
    """For each document, how much of it is found elsewhere."""
    documents = table(spark, folder, "documents")
    return spans.shared_parts(documents, "doc_id", "text", p10_spans(spark, folder)).withColumn("shared_share", F.round("shared_share", 9))


QUERIES = {
    "p1_found": p1_found,
    "p1_collapsed": p1_collapsed,
    "p2_found": p2_found,
    "p2_terms": p2_terms,
    "p3_found": p3_found,
    "p3_top": p3_top,
    "p4_found": p4_found,
    "p4_candidates": p4_candidates,
    "p4_unmatched": p4_unmatched,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_spans": p10_spans,
    "p10_shared": p10_shared,
}

_KEYS = " , ".join(f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS c{i}" for i, c in enumerate(COPY_COLUMNS))
_COPIES = f"""
WITH a AS (SELECT row_id, {_KEYS} FROM master WHERE {' AND '.join(ps.present(c) for c in COPY_COLUMNS)}),
b AS (SELECT row_id, list_sort([c0, c1, c2]) AS k FROM a WHERE c0 <> '' AND c1 <> '' AND c2 <> ''),
g AS (SELECT row_id, min(row_id) OVER (PARTITION BY k) AS first, count(*) OVER (PARTITION BY k) AS n FROM b)
"""
_TERMS = f"""
WITH r AS ({' UNION ALL '.join(f"SELECT row_id, '{f}' AS field_name, {ps.item_list(f)} AS x FROM master" for f in TERM_FIELDS)}),
h AS (SELECT field_name, count(*) AS holders FROM r WHERE len(x) > 0 GROUP BY ALL),
t AS (SELECT row_id, field_name, {ps.folded('i')} AS term FROM (SELECT row_id, field_name, unnest(x) AS i FROM r)),
c AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM t GROUP BY ALL),
m AS (SELECT c.*, records / holders AS share,
    CASE WHEN records < 3 THEN 'rare' WHEN records / holders > 0.10 THEN 'common' END AS mark FROM c JOIN h USING (field_name))
"""
_NAMED = f"""
WITH i AS (SELECT 'publication_title' AS field_name, {ps.folded('publication_title')} AS item FROM master WHERE {ps.present('publication_title')}
    UNION ALL SELECT 'authors', {ps.folded('a')} FROM (SELECT unnest({ps.item_list('authors')}) AS a FROM master)),
c AS (SELECT field_name, item, count(*) AS n FROM i GROUP BY ALL)
"""
_PLAIN = "list_filter(string_split_regex(regexp_replace(lower(strip_accents({c})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_FIRST = ", ".join("('{}', '{}')".format(*pair.split("=")) for pair in FIRST_WORDS.split())
_CANDIDATES = f"""
WITH r AS (SELECT place_id, {_PLAIN.format(c='city')} AS w FROM place_reference),
n AS (SELECT place_id, array_to_string(w, '') AS name FROM r
    UNION ALL SELECT place_id, alias || array_to_string(w[2:], '') FROM r JOIN (VALUES {_FIRST}) a(word, alias) ON w[1] = word),
t AS (SELECT DISTINCT trim(publisher_city, {ps.BLANKS}) AS city FROM master WHERE {ps.present('publisher_city')}),
k AS (SELECT city, array_to_string({_PLAIN.format(c='city')}, '') AS k FROM t)
SELECT city, place_id, CAST(min(levenshtein(k, name)) AS INTEGER) AS errors FROM k JOIN n
    ON levenshtein(k, name) <= CASE WHEN length(k) < 4 THEN 0 WHEN length(k) < 7 THEN 1 ELSE 2 END WHERE k <> '' GROUP BY ALL
"""
_TAIL = "|".join(p.replace(".", " ") for k in (places.COUNTRY, places.AFTER) for p in AROUND[k])
_HEAD = "|".join(AROUND[places.BEFORE])


def _bare(x: str) -> str:
    """Typed words without numbers and the words around a name, taken off one after the other."""
    for _ in range(4):
        x = f"regexp_replace(regexp_replace({x}, '^(.+?) (?:[0-9]+|{_TAIL})$', '\\1'), '^(?:{_HEAD}) (.+)$', '\\1')"
    return x


_WORDS = "array_to_string(" + _PLAIN + ", ' ')"
_CODES = ", ".join("('{}', '{}')".format(*pair.replace(".", "").split("=")) for pair in PROVINCES.split())
_ALLOWED = "CASE WHEN length({k}) < 4 THEN 0 WHEN length({k}) < 7 THEN 1 ELSE 2 END"
_MEANT = f"""
WITH r AS (SELECT place_id, coalesce(province, '') AS province, {_PLAIN.format(c='city')} AS w FROM place_reference WHERE city IS NOT NULL),
n AS (SELECT place_id, array_to_string(w, '') AS name FROM r
    UNION ALL SELECT place_id, alias || array_to_string(w[2:], '') FROM r JOIN (VALUES {_FIRST}) a(word, alias) ON w[1] = word),
pk AS (SELECT DISTINCT * FROM (SELECT replace({_WORDS.format(c='province')}, ' ', '') AS key, province AS code FROM place_reference
    UNION ALL SELECT replace({_WORDS.format(c='province_name')}, ' ', ''), province FROM place_reference
    UNION ALL SELECT alias, code FROM (VALUES {_CODES}) a(code, alias) WHERE code IN (SELECT province FROM place_reference)) WHERE key <> ''),
m AS (SELECT row_id, publisher_city AS city, publisher_province AS province FROM master WHERE {ps.present('publisher_city')}
    AND NOT EXISTS (SELECT 1 FROM place_reference p WHERE p.city = publisher_city AND p.province = publisher_province)),
t AS (SELECT *, {_bare('cw')} AS cs FROM (SELECT DISTINCT city, province, {_WORDS.format(c='city')} AS cw,
    {_bare(_WORDS.format(c=f"(CASE WHEN {ps.present('province')} THEN province ELSE '' END)"))} AS pw FROM m)),
k AS (SELECT replace(pw, ' ', '') AS key FROM t UNION SELECT replace(cs, ' ', '') FROM t),
pc AS (SELECT k.key, CASE WHEN max(pk.key = k.key) THEN max(code) FILTER (pk.key = k.key) WHEN count(DISTINCT code) = 1 THEN max(code) END AS code
    FROM k JOIN pk ON pk.key = k.key OR (length(k.key) >= 7 AND length(pk.key) >= 7 AND levenshtein(pk.key, k.key) <= 1) GROUP BY 1),
h AS (SELECT city, province, CASE WHEN pw <> '' AND a.code IS NULL AND b.code IS NOT NULL THEN pw ELSE cw END AS w,
    CASE WHEN pw <> '' THEN coalesce(a.code, b.code, '?') END AS hint
    FROM t LEFT JOIN pc a ON a.key = replace(pw, ' ', '') LEFT JOIN pc b ON b.key = replace(cs, ' ', '')),
s AS (SELECT *, {_bare('w')} AS bare FROM h),
l AS (SELECT *, string_split(bare, ' ') AS parts FROM s),
x AS (SELECT city, province, hint, 0 AS turn, w, NULL AS code FROM s UNION ALL SELECT city, province, hint, 1, bare, NULL FROM s WHERE bare <> w
    UNION ALL SELECT city, province, hint, 1 + i, {_bare("array_to_string(parts[:len(parts) - i], ' ')")}, pk.code
    FROM (SELECT *, unnest([1, 2, 3]) AS i FROM l) JOIN pk ON i < len(parts) AND pk.key = array_to_string(parts[len(parts) - i + 1:], '')),
y AS (SELECT city, province, hint, turn, code, replace(w, ' ', '') AS key FROM x),
c AS (SELECT y.*, place_id, levenshtein(key, name) AS errors FROM y JOIN n ON key <> '' AND levenshtein(key, name) <= {_ALLOWED.format(k='key')}),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY city, province, place_id ORDER BY errors, turn) = 1),
f AS (SELECT b.city, b.province, place_id, (hint IS NULL OR hint = r.province) AND (code IS NULL OR code = r.province) AS agrees
    FROM b JOIN r USING (place_id) QUALIFY errors = min(errors) OVER (PARTITION BY b.city, b.province)),
g AS (SELECT city, province, count(*) FILTER (agrees) AS fits, max(place_id) FILTER (agrees) AS place FROM f GROUP BY ALL),
o AS (SELECT m.*, CASE WHEN fits = 1 THEN place ELSE 0 END AS place_id, CASE WHEN fits = 1 THEN 'matched' WHEN fits > 1 THEN 'ambiguous' ELSE 'unlisted' END AS status
    FROM m LEFT JOIN g ON g.city = m.city AND g.province IS NOT DISTINCT FROM m.province)
"""
_LEAKS = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, p AS dp, hash(w[p:p + 12]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
ig AS (SELECT item_id, p AS ip, hash(w[p:p + 12]) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS p FROM i)),
m AS (SELECT item_id, doc_id, dp, dp - ip AS shift FROM dg JOIN ig USING (g)),
n AS (SELECT *, dp - row_number() OVER (PARTITION BY item_id, doc_id, shift ORDER BY dp) AS run FROM m),
runs AS (SELECT item_id, doc_id, count(*) + 12 AS words FROM n GROUP BY item_id, doc_id, shift, run)
"""
_SHARED = """
WITH w AS (SELECT doc_id, p, md5(substr(text, p, 160)) AS h
    FROM (SELECT doc_id, text, unnest(range(1, length(text) - 158)) AS p FROM documents)),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT DISTINCT doc_id, p - 1 AS p FROM w SEMI JOIN r USING (h)),
g AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 160, false) AS gap FROM s),
n AS (SELECT doc_id, p, sum(CAST(gap AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM g),
x AS (SELECT doc_id, min(p) AS span_start, max(p) - min(p) + 160 AS span_length FROM n GROUP BY doc_id, island)
"""

ORACLE = {
    "p1_found": _COPIES + "SELECT first AS row_id_a, row_id AS row_id_b FROM g WHERE row_id <> first",
    "p1_collapsed": _COPIES + "SELECT row_id, n AS copies FROM g WHERE row_id = first",
    "p2_found": _TERMS + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_terms": _TERMS + "SELECT field_name, term, occurrences, records, round(share, 9) AS share, coalesce(mark, '-') AS mark FROM m",
    "p3_found": _NAMED + "SELECT field_name, item FROM c QUALIFY n >= 0.005 * sum(n) OVER (PARTITION BY field_name)",
    "p4_found": _MEANT + "SELECT row_id, CAST(place_id AS BIGINT) AS place_id FROM o",
    "p4_unmatched": _MEANT
    + f"""SELECT trim(city, {ps.BLANKS}) AS city, coalesce(trim(province, {ps.BLANKS}), '') AS province, status, count(*) AS records
FROM o WHERE place_id = 0 GROUP BY ALL""",
    "p4_candidates": _CANDIDATES,
    "p8_found": _LEAKS + "SELECT DISTINCT item_id, doc_id FROM runs",
    "p8_items": _LEAKS + "SELECT item_id, count(DISTINCT doc_id) AS documents, CAST(max(words) AS INTEGER) AS longest_run FROM runs GROUP BY item_id",
    "p10_found": _SHARED + "SELECT DISTINCT doc_id FROM x",
    "p10_spans": _SHARED + "SELECT * FROM x",
    "p10_shared": _SHARED
    + """SELECT d.doc_id, d.n_chars, CAST(coalesce(sum(span_length), 0) AS BIGINT) AS shared_chars, count(span_length) AS spans,
round(coalesce(sum(span_length), 0) / d.n_chars, 9) AS shared_share
FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id GROUP BY d.doc_id, d.n_chars""",
    "p3_top": _NAMED
    + """SELECT field_name, item, n, CAST(row_number() OVER (PARTITION BY field_name ORDER BY n DESC, item) AS INTEGER) AS rank
FROM c QUALIFY rank <= 50""",
}
