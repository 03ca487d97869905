"""Many keywords in many texts: one automaton over all keywords, by which each text is read once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keywords, and characters of all of them, for which an automaton is built; more are joined with the texts.
MOST_KEYWORDS, MOST_CHARACTERS = 200_000, 1 << 23


def vocabulary(keywords: DataFrame, column: str = "keyword") -> list[str] | None:
    """The distinct keywords that are not empty; None if there are too many for an automaton."""
    distinct = keywords.select(column).where(F.length(column) > 0).distinct()
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("characters")).first()
    if size["n"] > MOST_KEYWORDS or size["characters"] > MOST_CHARACTERS:
        return None
    return sorted(r[0] for r in distinct.collect())


def with_found(texts: DataFrame, column: str, words: list[str], name: str = "found") -> DataFrame:
    """``texts`` with ``name``: the distinct ``words`` that the text holds anywhere, in their order; none in a null text."""
    at = texts.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, word in enumerate(words):
            automaton.add_word(word, k)
        automaton.make_automaton()
        for batch in batches:
            found = [[words[k] for k in sorted({k for _, k in automaton.iter(t)})] if t and words else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, name])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))]))
