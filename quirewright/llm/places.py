"""Mapping of freely typed places to a reference list: a trie searched with a Levenshtein automaton.

The trie holds the cleaned name of every entry and its alias paths (other first words, from a table of aliases). The
automaton is the nondeterministic one, run bit-parallel: one integer per number of errors holds the reached positions
of the typed value, and a branch of the trie is left as soon as all of them are zero. It returns every entry within a
distance that depends on the length; the nearest ones whose province agrees are what a typed place may mean.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewright.functions.packed import MISSING, is_missing, trimmed
from quirewright.operators.skew import join_groups
from quirewright.session import written

#: Length of the cleaned name from which one and two errors are allowed.
ONE_ERROR, TWO_ERRORS = 4, 7
#: Entries that a worker holds at once; a longer list is searched in blocks.
BLOCK = 200_000
#: Distinct typed places that meet a block in one task.
VALUES_AT_ONCE = 50_000
_MEMO = 100_000
#: Aliases are rows (kind, name, alias). The kinds: another form of the first word of a city, another form of a province
#: (by its code), and words that may stand before a city, after it, or after it for the country.
ALIAS_SCHEMA = "kind STRING, name STRING, alias STRING"
WORD, PROVINCE, BEFORE, AFTER, COUNTRY = "first_word", "province", "before", "after", "country"


def allowed(length: int) -> int:
    return 0 if length < ONE_ERROR else 1 if length < TWO_ERRORS else 2


def clean(text: str) -> list[str]:
    """Words of letters and digits, without accents, in lower case."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain.lower())


class Trie:
    """Names with the ids they stand for, searched within a number of errors."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, name: str, value) -> None:
        node = self.root
        for c in name:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(value)

    def search(self, typed: str, errors: int) -> dict:
        """value -> fewest errors, for every name within ``errors`` insertions, deletions and substitutions."""
        n, last = len(typed), 1 << len(typed)
        masks: dict[str, int] = {}
        for i, c in enumerate(typed):
            masks[c] = masks.get(c, 0) | 1 << i
        found: dict = {}
        full = (last << 1) - 1
        stack = [(self.root, tuple(((1 << e + 1) - 1) & full for e in range(errors + 1)))]
        while stack:
            node, reached = stack.pop()
            if "" in node:
                for e, r in enumerate(reached):
                    if r & last:
                        for v in node[""]:
                            found[v] = min(e, found.get(v, e))
                        break
            for c, child in node.items():
                if not c:
                    continue
                mask, before, new = masks.get(c, 0), 0, []
                made = 0
                for e in range(errors + 1):
                    old = reached[e]
                    made = ((old & mask) << 1) | before | (before << 1) | (made << 1 if e else 0)
                    made &= full
                    new.append(made)
                    before = old
                if made:
                    stack.append((child, tuple(new)))
        return found if n else {}


class Places:
    """Entries (place_id, city, province, province_name) with their alias paths; ``provinces`` are (code, name) of all entries."""

    def __init__(self, entries: list[tuple], aliases: list[tuple], provinces: list[tuple] | None = None) -> None:
        self.cities, self.provinces, self.province_of = Trie(), {}, {}
        self.province_names = Trie()
        of = {kind: {} for kind in (WORD, PROVINCE, BEFORE, AFTER, COUNTRY)}
        for kind, name, alias in aliases:
            of[kind].setdefault(name if kind == PROVINCE else "".join(clean(name or "")), []).append(clean(alias))
        self.before = [p for ps in of[BEFORE].values() for p in ps]
        self.after = [p for k in (COUNTRY, AFTER) for ps in of[k].values() for p in ps]
        for place, city, province, _ in entries:
            words = clean(city or "")
            self.province_of[place] = province or ""
            for first in [words[:1], *of[WORD].get(words[0], [])] if words else []:
                self.cities.add("".join([*first, *words[1:]]), place)
        for code, name in provinces if provinces is not None else {(e[2], e[3]) for e in entries}:
            for alias in [clean(code or ""), clean(name or ""), *of[PROVINCE].get(code, [])]:
                key = "".join(alias)
                if key:
                    self.provinces[key] = code
                    if len(key) >= TWO_ERRORS:
                        self.province_names.add(key, code)
        self._memo: dict = {}

    def province(self, words: list[str]) -> str | None:
        """Code of a province written as code, name or alias, or as a long one of these with one error; None if it is none."""
        key = "".join(words)
        if key in self.provinces:
            return self.provinces[key]
        near = self.province_names.search(key, 1) if len(key) >= TWO_ERRORS else {}
        return next(iter(near)) if len(near) == 1 else None

    def _stripped(self, words: list[str]) -> list[str]:
        """Without postal codes, country and the words around a name, as long as something is left."""
        changed = True
        while changed and words:
            changed = False
            if len(words) > 1 and words[-1].isdigit():
                words, changed = words[:-1], True
            for p in self.after:
                if len(words) > len(p) and words[-len(p) :] == p:
                    words, changed = words[: -len(p)], True
            for p in self.before:
                if len(words) > len(p) and words[: len(p)] == p:
                    words, changed = words[len(p) :], True
        return words

    def near(self, name: str) -> dict:
        """Entry -> errors, of all entries within the distance that the length of ``name`` allows."""
        if name not in self._memo:
            if len(self._memo) >= _MEMO:
                self._memo.clear()
            self._memo[name] = self.cities.search(name, allowed(len(name)))
        return self._memo[name]

    def meant(self, city: str | None, province: str | None) -> list[tuple[int, int, bool]]:
        """(place_id, errors, agrees) of the nearest entries: ``agrees`` says that no province that is written contradicts.

        The province may stand in its own field, after the city, or in the city's place; one that the list does not have
        contradicts every entry.
        """
        words, beside = clean(city or ""), self._stripped(clean(province or ""))
        hint = self.province(beside) if beside else None
        if hint is None and beside:
            if (swapped := self.province(self._stripped(words))) is not None:
                words, hint = beside, swapped
            else:
                hint = _NOWHERE
        tries = [(words, None)]
        stripped = self._stripped(words)
        if stripped != words:
            tries.append((stripped, None))
        for n in range(1, min(3, len(stripped) - 1) + 1):
            code = self.provinces.get("".join(stripped[-n:]), _NOWHERE)
            if code != _NOWHERE:
                tries.append((self._stripped(stripped[:-n]), code))
        best: dict = {}
        for part, code in tries:
            for place, errors in self.near("".join(part)).items():
                if errors < best.get(place, (9, None))[0]:
                    best[place] = (errors, code)
        least = min((e for e, _ in best.values()), default=0)
        return [(p, e, all(h is None or h == self.province_of[p] for h in (hint, code))) for p, (e, code) in best.items() if e == least]


#: A province that is written but not listed; no code is equal to it.
_NOWHERE = "\x00"


def decided(found: list[tuple[int, int, bool]]) -> tuple[int, str]:
    """(place_id, status) of what may be meant: ``matched``, or 0 with ``ambiguous`` or ``unlisted``; nothing is guessed."""
    fits = [p for p, _, agrees in found if agrees]
    return (fits[0], "matched") if len(fits) == 1 else (0, "ambiguous" if fits else "unlisted")


_HELD: dict = {}


def _held(shared, name: str) -> Places:
    """The list of a broadcast, built once in each worker and kept by its ``name`` for the worker's next tasks."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Places(*shared.value)
    return _HELD[name]


def _present(province: str | None) -> str | None:
    return None if province is None or province.strip(" \t\r\n\xa0") in MISSING else province


def _mapper(shared):
    name = uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        places, memo = _held(shared, name), {}
        for b in batches:
            out = []
            for pair in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = memo.get(pair)
                if got is None:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    got = memo[pair] = decided(places.meant(pair[0], _present(pair[1])))
                out.append(got)
            ids, states = [x[0] for x in out], [x[1] for x in out]
            yield pa.record_batch(
                [b.column(0), pa.array(ids, pa.int64()), pa.array(states, pa.string()), b.column(1), b.column(2)],
                names=["row_id", "place_id", "status", "city", "province"],
            )

    return run


def _block_search(aliases: list[tuple], provinces: list[tuple]):
    """The places that some typed values may mean among the entries of one block."""

    def run(values: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(values):
            return pd.DataFrame({"pair": [], "place_id": [], "errors": [], "agrees": []})
        text = lambda c: [None if pd.isna(x) else x for x in entries[c]]
        places = Places(list(zip(entries["place_id"], text("city"), text("province"), text("province_name"), strict=True)), aliases, provinces)
        plain = lambda c: [None if pd.isna(x) else x for x in values[c]]
        rows = [(pair, *m) for pair, city, province in zip(values["pair"], plain("city"), plain("province"), strict=True) for m in places.meant(city, _present(province))]
        return pd.DataFrame(rows, columns=["pair", "place_id", "errors", "agrees"])

    return run


def _mapped_in_blocks(typed: DataFrame, listed: DataFrame, aliases: list[tuple], provinces: list[tuple], count: int, block: int) -> DataFrame:
    """The same for a list that no worker holds: each distinct typed place meets every block, the nearest of all count."""
    pair = F.xxhash64("city", "province")
    counts = typed.groupBy("city", "province").agg(F.count(F.lit(1)).alias("n"))
    values = written(counts.select("city", "province", "n", F.unhex(F.md5(F.to_json(F.struct("city", "province")))).alias("pair")), "typed_places")
    sizes = values.agg(F.count(F.lit(1)), F.sum("n")).first()
    blocks, parts = -(-count // block), max(1, -(-sizes[0] // VALUES_AT_ONCE))
    here = values.select("pair", "city", "province", F.pmod(pair, F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    there = listed.select("*", F.pmod(F.xxhash64("place_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))
    found = here.groupBy("block", "part").cogroup(there.groupBy("block", "part")).applyInPandas(
        _block_search(aliases, provinces), "pair BINARY, place_id BIGINT, errors INT, agrees BOOLEAN"
    )
    least = F.min("errors").over(Window.partitionBy("pair"))
    nearest = found.withColumn("least", least).where("errors = least")
    fits = nearest.groupBy("pair").agg(F.count_if("agrees").alias("fits"), F.max(F.when(F.col("agrees"), F.col("place_id"))).alias("place"))
    some = F.coalesce("fits", F.lit(0))
    answers = values.join(fits, "pair", "left").select(
        "pair",
        F.when(some == 1, F.col("place")).otherwise(F.lit(0)).alias("place_id"),
        F.when(some == 1, F.lit("matched")).when(some > 1, F.lit("ambiguous")).otherwise(F.lit("unlisted")).alias("status"),
        "n",
    )
    keyed = typed.withColumn("pair", F.unhex(F.md5(F.to_json(F.struct("city", "province")))))
    return join_groups(keyed, written(answers, "place_answers"), ["pair"], "n", sizes[1] or 0).select("row_id", "place_id", "status", "city", "province")


def _listed(reference: DataFrame) -> DataFrame:
    return reference.where("city IS NOT NULL").select(F.col("place_id").cast("bigint"), "city", "province", "province_name")


def mapped_places(df: DataFrame, reference: DataFrame, aliases: DataFrame, id_column: str, city: str, province: str, block: int = BLOCK) -> DataFrame:
    """(row_id, place_id, status, city, province) of the rows whose place is not written exactly as in ``reference``.

    Rows with a missing city are left out; place_id is 0 for a place that is not listed, contradicts its province or
    fits several entries equally. Exact rows are dropped by a broadcast join before Python; the others are resolved
    where they lie, each worker remembering values it has seen, so a value held by a third of all rows costs no shuffle
    and one search. A list of more than ``block`` entries is searched in blocks, once per distinct typed place.
    ``aliases`` has the columns of ALIAS_SCHEMA and is small, as it is written by hand.
    """
    listed = _listed(reference)
    known = [tuple(r) for r in aliases.select("kind", "name", "alias").collect()]
    count = listed.count()
    rows = df.select(F.col(id_column).cast("bigint").alias("row_id"), F.col(city).alias("city"), F.col(province).alias("province"))
    exact = listed.select("city", "province").distinct()
    typed = rows.where(~is_missing(F.col("city"))).join(F.broadcast(exact) if count <= block else exact, ["city", "province"], "left_anti")
    typed = typed.select("row_id", "city", "province")
    if count > block:
        provinces = [tuple(r) for r in listed.select("province", "province_name").distinct().collect()]  # a row per province
        return _mapped_in_blocks(written(typed, "typed"), listed, known, provinces, count, block)
    shared = df.sparkSession.sparkContext.broadcast(([tuple(r) for r in listed.collect()], known))
    return typed.mapInArrow(_mapper(shared), "row_id BIGINT, place_id BIGINT, status STRING, city STRING, province STRING")


def _candidate_search(shared):
    name = uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        places = _held(shared, name)
        for b in batches:
            rows = [(t, p, e) for t in b.column(0).to_pylist() for p, e in places.near("".join(clean(t or ""))).items()]
            if rows:
                typed, place, errors = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(typed, pa.string()), pa.array(place, pa.int64()), pa.array(errors, pa.int32())], names=["city", "place_id", "errors"])

    return run


def candidates(df: DataFrame, reference: DataFrame, aliases: DataFrame, city: str, block: int = BLOCK) -> DataFrame:
    """(city, place_id, errors): for every distinct typed city all entries within the distance that its length allows.

    The name alone is looked at, with its alias paths, whatever the province; missing cities have no candidates. The
    list is taken in blocks of ``block`` entries, one after the other for each typed city.
    """
    values = df.where(~is_missing(F.col(city))).select(trimmed(F.col(city)).alias("city")).distinct()
    known = [tuple(r) for r in aliases.select("kind", "name", "alias").collect()]
    listed, out = _listed(reference), None
    blocks = max(1, -(-listed.count() // block))
    values = written(values, "typed_cities")
    for k in range(blocks):
        part = [tuple(r) for r in listed.where(F.pmod(F.xxhash64("place_id"), F.lit(blocks)) == k).collect()]  # at most about ``block`` entries
        shared = df.sparkSession.sparkContext.broadcast((part, known))
        found = values.mapInArrow(_candidate_search(shared), "city STRING, place_id BIGINT, errors INT")
        out = found if out is None else out.union(found)
    return out


def unmatched_values(mapped: DataFrame) -> DataFrame:
    """(city, province, status, records): the typed values that have no entry, trimmed, with how many records hold them."""
    values = mapped.where("place_id = 0").select(
        trimmed(F.col("city")).alias("city"), F.coalesce(trimmed(F.col("province")), F.lit("")).alias("province"), "status"
    )
    return values.groupBy("city", "province", "status").agg(F.count(F.lit(1)).alias("records"))
