"""Text functions: Unicode trims, page labels, headings, dates, keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of line of which a page label or a heading consists. Patterns.
PRINTED_NUMBER = r"(?U)^(\d{1,4}|[IVXLCDM]{1,7})$"
SECTION_HEADING = r"(?U)^([一二三四五六七八九十]+、\S|\d+(\.\d+){1,3}\s+\S)"
DATE = r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
TABLE_QUESTION = r"(?U)表\s*\d+"
SENTENCE_END = r"(?<=[。！？.!?])"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def not_blank(c: Column) -> Column:
    """Whether anything but Unicode white space is in it; read up to the first such character."""
    return F.regexp_like(c, F.lit(r"(?U)\S"))


def normalised(c: Column) -> Column:
    """Trimmed and in lower case."""
    return F.lower(trimmed(c))


def lines(c: Column) -> Column:
    """Lines as Python's splitlines has them: no empty last one; form feeds, U+0085 and U+2028 break lines too."""
    split = F.split(c, r"\R|[\x1c-\x1e]")
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.element_at(split, -1) == "", F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(0)))).otherwise(split)


#: What ends a line, beside a line feed.
BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def printed_page_number(text: Column) -> Column:
    """The last line that is not empty if it is a number or a Roman numeral, else the first one, else null."""
    body = trimmed(F.translate(text, BREAKS, "\n" * len(BREAKS)))
    fits = lambda x: F.when(x.rlike(PRINTED_NUMBER), x)
    line = lambda which: trimmed(F.substring_index(body, "\n", which))
    return F.coalesce(fits(line(-1)), fits(line(1)))


def section_heading(text: Column) -> Column:
    """The first line that looks like a numbered heading, else null."""
    return F.try_element_at(F.filter(F.transform(lines(text), trimmed), lambda x: x.rlike(SECTION_HEADING)), F.lit(1))


def dates(question: Column) -> Column:
    """All dates of a question: array of year, month, day."""
    part = lambda n: F.transform(F.regexp_extract_all(question, F.lit(DATE), F.lit(n)), lambda x: x.cast("int"))
    zipped = F.arrays_zip(part(1).alias("year"), part(2).alias("month"), part(3).alias("day"))
    return F.transform(zipped, lambda d: F.struct(d["year"].alias("year"), d["month"].alias("month"), d["day"].alias("day")))


def mentions_date(text: Column, wanted: Column) -> Column:
    """Whether the text holds one of the dates, in any spacing; months and days unpadded, as asked."""
    form = lambda d: F.concat(F.lit("(?U)"), d["year"].cast("string"), F.lit(r"\s*年\s*"), d["month"].cast("string"), F.lit(r"\s*月\s*"), d["day"].cast("string"), F.lit(r"\s*日"))
    return F.coalesce(F.exists(wanted, lambda d: F.regexp_like(text, form(d))), F.lit(False))


def is_table_question(question: Column) -> Column:
    return question.rlike(TABLE_QUESTION)


def sentences(text: Column) -> Column:
    """Sentences with their closing marks, none empty."""
    return F.filter(F.split(text, SENTENCE_END), lambda x: F.length(x) > 0)


def slices(text: Column, n: int) -> Column:
    """Runs of n code points."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(n)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def contains_all(text: Column, keywords: Column) -> Column:
    """Every keyword stands in the text, letter for letter; false for no keywords."""
    return F.coalesce(F.forall(keywords, lambda k: F.contains(text, k)) & (F.size(keywords) > 0), F.lit(False))


def preview(text: Column, n: int = 150) -> Column:
    return F.substring(text, 1, n)
