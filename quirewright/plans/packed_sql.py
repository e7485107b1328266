"""DuckDB SQL for the items of a packed field, derived apart from the Spark operator, for side-by-side checks."""

BLANKS = "(' ' || chr(9) || chr(10) || chr(13) || chr(160))"
MISSING = "('', 'nan', 'NaN', 'N/A', 'n/a', 'NA', 'None', 'none', 'null', 'NULL')"


def present(column: str) -> str:
    return f"({column} IS NOT NULL AND trim({column}, {BLANKS}) NOT IN {MISSING})"


def folded(column: str) -> str:
    return f"lower(regexp_replace(trim({column}, {BLANKS}), '[ \\t\\r\\n\\x{{a0}}]+', ' ', 'g'))"


def item_list(column: str) -> str:
    """A list-valued expression: quoted strings of a bracketed list by one pattern, else quoted or plain runs."""
    t = f"trim({column}, {BLANKS})"
    listed = (
        f"list_transform(regexp_extract_all({t}, '''(?:[^''\\\\]|\\\\.)*''|\"(?:[^\"\\\\]|\\\\.)*\"'), "
        f"lambda x: replace(replace(replace(x[2:-2], '\\''', ''''), '\\\"', '\"'), '\\x01', chr(1)))"
    )
    plain = (
        f"list_transform(regexp_extract_all({t}, '\"(?:[^\"]|\"\")*\"|[^;|\\r\\n\"]+'), "
        f"lambda x: CASE WHEN x LIKE '\"%\"' THEN x[2:-2] WHEN trim(x, {BLANKS}) = ',' THEN '' ELSE x END)"
    )
    found = f"CASE WHEN {t} LIKE '[%]' THEN {listed} ELSE {plain} END"
    return (
        f"CASE WHEN {present(column)} THEN list_filter(list_transform({found}, lambda x: trim(x, {BLANKS})), "
        f"lambda x: x NOT IN {MISSING}) ELSE [] END"
    )
