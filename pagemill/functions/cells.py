"""What a record looks like in a spreadsheet cell or a result table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import pattern

# Display names of the record types.
TYPE_LABELS = {
    "title": "Title",
    "meta_description": "Meta",
    "meta_keywords": "Meta",
    "heading": "Heading",
    "paragraph": "Paragraph",
    "link": "Link",
    "image": "Image",
    "table_row": "Table Row",
    "open_graph": "Open Graph",
    "canonical_url": "Canonical",
}


def clean_cell(text: str) -> Column:
    """Formula prefixes neutralised with a quote, then ``& < >`` escaped."""
    guarded = f"CASE WHEN rlike({text}, {pattern(r'\A[=+@-]')}) THEN concat(\"'\", {text}) ELSE {text} END"
    return F.expr(f"replace(replace(replace({guarded}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")


def type_label(kind: str) -> Column:
    """Display name of a record type, the type itself when it has none."""
    cases = " ".join(f"WHEN '{name}' THEN '{label}'" for name, label in TYPE_LABELS.items())
    return F.expr(f"CASE {kind} {cases} ELSE {kind} END")


def display_text(text: str) -> Column:
    return F.expr(f"coalesce({text}, '')")
