"""Deterministic identities of documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    """SHA-256 of bytes or text, lower-case hex."""
    return F.sha2(c, 256)


def metadata_hash(labels: Column, section: Column, table: Column) -> Column:
    """SHA-256 of the list of page labels, section and table title, as JSON with sorted keys and a space after separators.

    Nulls are kept. The bytes are those of Python's ``json.dumps`` (but for control characters other than white space).
    """
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    listed = F.when(labels.isNull(), "null").otherwise(F.concat(F.lit("["), F.concat_ws(", ", F.transform(labels, text)), F.lit("]")))
    fields = (('{"printed_page_number_list": ', listed), (', "section_title": ', text(section)), (', "table_title": ', text(table)))
    return F.sha2(F.concat(*(x for name, value in fields for x in (F.lit(name), value)), F.lit("}")), 256)


def chunk_id(document: Column, strategy: Column, kind: Column, start: Column, end: Column, text_hash: Column) -> Column:
    """Identity of a chunk: where it stands, how it was cut, and what it says."""
    return F.sha2(F.concat_ws(":", document, strategy, kind, start.cast("string"), end.cast("string"), text_hash), 256)
