"""Splitting of packed fields: several values in one string, with delimiters and quoting that vary by row.

The value is split on its quote characters. In the regular case the odd pieces are then literals and the even
pieces hold delimiters and unquoted values; ``transform`` and ``flatten`` put the items together again in order.
Values in which quotes are escaped, of two kinds, or stray go through a fold over the same pieces that keeps
track of the open quote.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as whitespace and as a missing value.
BLANKS = " \t\r\n\u00a0"
MISSING = ("", "nan", "NaN", "N/A", "n/a", "NA", "None", "none", "null", "NULL")

WS = r"[ \t\r\n\u00a0]"
DELIMITERS = r"[;|\r\n]"

_LIST_START = rf"^\[{WS}*(?:['\"\]]|None{WS}*[,\]])"
_LIST_END = rf"(?:['\"\[]|None{WS}*){WS}*,?{WS}*\]$"
_LIST_EVEN = rf"^(?:{WS}|[\[\],]|None)*$"
_TEXT_EVEN_FIRST = rf"^(?:|(?s).*{DELIMITERS}){WS}*$"

# private-use marks of an opened or closed quote and of a protected delimiter
_Q, _SEMI, _BAR, _COMMA, _CR, _LF = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005"
_PLAIN, _MASK = ";|,\r\n", _SEMI + _BAR + _COMMA + _CR + _LF
# text that holds such a character itself has it spelt as an escape and a letter meanwhile
_ESCAPE = "\ue00f"
_SPELT = {m: _ESCAPE + chr(ord("a") + i) for i, m in enumerate(_ESCAPE + _Q + _MASK + "\ue010\ue011\ue012")}


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_missing(c: Column) -> Column:
    """Null, or one of the ten missing tokens after trimming; never null itself."""
    return c.isNull() | trimmed(c).isin(*MISSING)


def folded(c: Column) -> Column:
    """Trimmed, runs of whitespace made one space, lower case."""
    return F.lower(F.regexp_replace(trimmed(c), rf"{WS}+", " "))


def _kept(items: Column) -> Column:
    return F.filter(F.transform(items, trimmed), lambda x: ~x.isin(*MISSING))


def _unescaped(literal: Column) -> Column:
    r"""Backslash escapes of a list literal, by the JSON reader (``\'`` and ``\xHH`` first made JSON)."""
    json = F.regexp_replace(literal, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    json = F.regexp_replace(json, r"\\'", "'")
    json = F.regexp_replace(json, r'(?<!\\)((?:\\\\)*)"', r'$1\\"')
    json = F.translate(json, "\r\n\t", "\ue010\ue011\ue012")
    read = F.from_json(F.concat(F.lit('["'), json, F.lit('"]')), "array<string>")
    value = F.translate(F.try_element_at(read, F.lit(1)), "\ue010\ue011\ue012", "\r\n\t")
    return F.when(literal.contains("\\"), F.coalesce(value, F.regexp_replace(literal, r"\\([\"'\\])", "$1"))).otherwise(literal)


def _once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, also where ``then`` uses it for every element of an array."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def _replaced(t: Column, pairs) -> Column:
    for a, b in pairs:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _folded_items(t: Column, is_list: Column) -> Column:
    """The items by ``_fold``, also of a text that holds one of its marks. What every item needs is evaluated once."""
    safe = F.when(t.rlike("[\ue000-\ue005\ue00f-\ue012]"), _replaced(t, _SPELT.items())).otherwise(t)
    back = [(spelt, mark) for mark, spelt in reversed(_SPELT.items())]
    quote = F.when(is_list & ~t.contains('"'), F.lit("'")).otherwise(F.lit('"'))
    once = F.struct(safe.alias("t"), is_list.alias("is_list"), quote.alias("quote"))
    found = _once(once, lambda v: _fold(v["t"], v["is_list"], v["quote"]))
    return F.transform(found, lambda x: F.when(x.contains(_ESCAPE), _replaced(x, back)).otherwise(x))


def _fold(t: Column, is_list: Column, char: Column) -> Column:
    """Items of a value whose quotes are escaped, of two kinds, or stray: one pass over its pieces.

    The state is the open quote and the text so far, in which delimiters inside quotes are masked. A quote opens
    only where an item starts, closes unless a backslash precedes it, and opens again if it is doubled.
    """
    pieces = F.split(t, r"(?=['\"])|(?<=['\"])")
    at_start = rf"(?s)(^|.*[;|\r\n]){WS}*$"
    start = F.struct(F.lit("").alias("q"), F.lit("").alias("out"), F.lit(False).alias("esc"))

    def step(s: Column, p: Column) -> Column:
        quote, outside = (p == "'") | (p == '"'), s.q == ""
        opens = outside & quote & (
            s.out.endswith(_Q) | F.when(is_list, s.out.rlike(rf"(^|[\[,]){WS}*$")).otherwise((p == '"') & s.out.rlike(at_start))
        )
        closes = ~outside & (p == s.q) & ~s.esc
        out = F.concat(s.out, F.when(opens | closes, F.lit(_Q)).when(outside, p).otherwise(F.translate(p, _PLAIN, _MASK)))
        q = F.when(opens, p).when(closes, F.lit("")).otherwise(s.q)
        escape = ~outside & ~quote & (F.length(F.regexp_extract(p, r"(\\*)$", 1)) % 2 == 1)
        return F.struct(q.alias("q"), out.alias("out"), escape.alias("esc"))

    # a quote that is never closed is ordinary text
    text = F.aggregate(pieces, start, step, lambda s: F.when(s.q == "", s.out).otherwise(t))
    inner = F.when(is_list, F.regexp_replace(text, rf"^\[|{WS}*,?{WS}*\]$", "")).otherwise(text)
    parts = F.when(is_list, F.split(inner, ",")).otherwise(
        F.split(F.regexp_replace(inner, rf"{_Q}{WS}*,{WS}*(?={_Q})", _Q + ";"), DELIMITERS)
    )

    def item(x: Column) -> Column:
        y = trimmed(x)
        quoted = y.startswith(_Q) & y.endswith(_Q) & (F.length(y) > 1)
        body = F.when(quoted, F.substring(y, F.lit(2), F.length(y) - 2)).otherwise(y)
        body = F.replace(F.replace(body, F.lit(_Q * 2), char), F.lit(_Q), char)
        body = F.translate(body, _MASK, _PLAIN)
        return F.when(quoted, _unescaped(body)).when(is_list & (body == "None"), F.lit("")).otherwise(body)

    return F.transform(parts, item)


def items(c: Column) -> Column:
    """The items of a packed field, in order: trimmed, unquoted, unescaped, missing ones dropped.

    Null, missing and empty values give an empty array, never null. Repeated items stay. An unclosed quote is
    ordinary text. A comma separates only items that are each in quotes.
    """
    t = trimmed(c)
    is_list = t.rlike(_LIST_START) & t.rlike(_LIST_END) & (F.length(t) > 1)
    has_d, has_s, has_b = t.contains('"'), t.contains("'"), t.contains("\\")

    def alternate(quote: str, even) -> Column:
        pieces = F.split(t, quote)
        return F.flatten(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(even(p))))

    def regular(quote: str, good) -> Column:
        def checked(pieces: Column) -> Column:
            each = F.transform(pieces, lambda p, i: (i % 2 == 1) | good(p, i, F.size(pieces) - 1))
            return (F.size(pieces) % 2 == 1) & F.forall(each, lambda x: x)

        return _once(F.split(t, quote), checked)

    def good_list(p: Column, i: Column, last: Column) -> Column:
        return p.rlike(_LIST_EVEN) & ((i == 0) | (i == last) | p.contains(","))

    def good_text(p: Column, i: Column, last: Column) -> Column:
        comma = (trimmed(p) == ",") & (i > 0) & (i < last)
        before = (i == 0) | p.rlike(rf"^{WS}*{DELIMITERS}") | ((i == last) & (trimmed(p) == ""))
        after = (i == last) | p.rlike(rf"{DELIMITERS}{WS}*$") | ((i == 0) & (trimmed(p) == ""))
        return comma | (before & after)

    empty = F.array().cast("array<string>")
    even_text = lambda p: F.when(trimmed(p) == ",", empty).otherwise(F.split(p, DELIMITERS))
    found = (
        F.when(is_list & ~has_b & ~has_d & regular("'", good_list), alternate("'", lambda p: empty))
        .when(is_list & ~has_b & ~has_s & regular('"', good_list), alternate('"', lambda p: empty))
        .when(~is_list & ~has_d, F.split(t, DELIMITERS))
        .when(~is_list & ~has_b & regular('"', good_text), alternate('"', even_text))
        .otherwise(_folded_items(t, is_list))
    )
    return F.when(is_missing(c), empty).otherwise(_kept(found))
