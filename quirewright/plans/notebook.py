"""A notebook over the tables of a run: one cell per table, to be opened where Spark is at hand."""

from __future__ import annotations

import json

SETUP = """from pyspark.sql import SparkSession
spark = SparkSession.builder.getOrCreate()
out = {out!r}
def show(name, rows=25):
    return spark.read.csv(f"{{out}}/csv/{{name}}", header=True, escape='"').limit(rows).toPandas()"""

#: Chapters and the tables that they show.
CHAPTERS = {
    "Coverage": ("core_summary", "coverage_metrics", "partition_quality", "column_completeness", "usable_fields"),
    "Sources and places": ("source_type_counts", "language_counts", "object_type_counts", "publisher_region_counts", "object_type_by_decade_share"),
    "Authors and depth of the metadata": ("author_coverage", "author_coverage_by_source", "author_coverage_since_2000", "metadata_depth", "page_statistics", "pages_anova"),
    "Duplicates": ("duplicate_summary",),
    "Publications": ("media_summary", "publication_examples", "publication_alias_audit", "canonical_rollup"),
    "Topics": ("topic_terms", "topic_counts", "topic_share_by_decade"),
    "Terms and tone": ("group_terms", "group_lexicon_totals", "tone_by_decade", "tone_anova", "tone_group_statistics"),
}


def _cell(kind: str, number: int, text: str) -> dict:
    cell = {"cell_type": kind, "id": f"cell-{number}", "metadata": {}, "source": text.splitlines(keepends=True)}
    return cell | ({"execution_count": None, "outputs": []} if kind == "code" else {})


def notebook(title: str, out: str, extra: tuple[str, ...] = ()) -> str:
    """The notebook as JSON; ``extra`` names further tables, for a last chapter."""
    texts = [("markdown", f"# {title}"), ("code", SETUP.format(out=out))]
    for chapter, tables in (CHAPTERS | ({"Further tables": extra} if extra else {})).items():
        texts += [("markdown", f"## {chapter}"), *(("code", f"show({t!r})") for t in tables)]
    cells = [_cell(kind, i, text) for i, (kind, text) in enumerate(texts)]
    return json.dumps({"cells": cells, "metadata": {"language_info": {"name": "python"}}, "nbformat": 4, "nbformat_minor": 5}, indent=1)
