"""Text functions as columns: patterns, truncation, escaping, citations, values. No UDF; every one stays in codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine import constants as C


def any_match(text: Column, *patterns: str) -> Column:
    """Whether any pattern is found, ignoring case."""
    return text.rlike("(?i)" + "|".join(patterns))


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def full_trim(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def project_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({C.PROJECT_ID})"), F.lit(1))


def dates(text: Column, *, month_only: bool = False) -> Column:
    """ISO, slashed and written dates, in this order of kinds; month_only keeps just the month of written ones."""
    written = r"(?i)((Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{1,2},?\s+\d{4})"
    return F.concat(
        F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(\d{1,2}/\d{1,2}/\d{4})"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(written), F.lit(2 if month_only else 1)),
    )


def hectares(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?i)(\d+(?:\.\d+)?)\s*(?:ha|hectares?)"), F.lit(1))


def percentages(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1))


def is_email(text: Column) -> Column:
    return text.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def iso_date(text: Column) -> Column:
    """A date from text that begins like one; null if there is no such day."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))


def number(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double"))


def page_of(source: Column) -> Column:
    """A page number: "page 7", else "p. 7", else "(7)"."""
    return F.coalesce(found(source, r"[Pp]age\s+(\d+)"), found(source, r"[Pp]\.\s*(\d+)"), found(source, r"\((\d+)\)")).try_cast("int")


def document_ref(source: Column) -> Column:
    return found(source, r"((?:DOC|REQ)-[A-Za-z0-9]+)")


def document_name(source: Column) -> Column:
    """The text before the first comma."""
    return F.trim(F.split(source, ",")[0])


def last_index(text: Column, part: str) -> Column:
    """Place of the last occurrence, from 1; 0 if there is none."""
    at = F.instr(F.reverse(text), part[::-1])
    return F.when(at > 0, F.length(text) - at - len(part) + 2).otherwise(0)


def truncate_at_paragraph(text: Column, cap: int = 80_000) -> Column:
    """At the last blank line within cap, else at cap, with a note of what was shown."""
    head = F.substring(text, 1, cap)
    cut = last_index(head, "\n\n") - 1
    kept = F.when(cut > 0, F.substring(head, F.lit(1), cut)).otherwise(head)
    note = F.concat(F.lit("\n\n_[showing first "), F.length(kept).cast("string"), F.lit(" of "), F.length(text).cast("string"), F.lit(" chars]_\n"))
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(kept, note))


def truncate_at_sentence(text: Column, cap: int = 200) -> Column:
    """At the last sentence end past half of cap, else at the last blank past 70 %, else at cap."""
    head = F.substring(text, 1, cap)
    sentence = F.greatest(*(last_index(head, e) for e in (". ", ".\n", ".\t"))) - 1
    blank = last_index(head, " ") - 1
    return (
        F.when(F.length(text) <= cap, text).when(sentence > cap * 0.5, F.substring(head, F.lit(1), sentence + 1))
        .when(blank > cap * 0.7, F.concat(F.substring(head, F.lit(1), blank), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    )


def limit_text(text: Column, cap: int = 50_000) -> Column:
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("\n[... truncated ...]"))).otherwise(text)


def escape_cell(text: Column) -> Column:
    """A Markdown cell: bars escaped, lines joined, angle brackets as entities but for line breaks."""
    flat = F.regexp_replace(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), "\r", "")
    return F.regexp_replace(F.regexp_replace(flat, "<(?!br>)", "&lt;"), "(?<!<br)>", "&gt;")


def citation(name: Column, section: Column, page: Column) -> Column:
    """name (Section s, p.n); null without a name."""
    inner = F.concat_ws(", ", F.concat(F.lit("Section "), section), F.concat(F.lit("p."), page.cast("string")))
    return F.when(name.isNull(), None).when(inner == "", name).otherwise(F.concat(name, F.lit(" ("), inner, F.lit(")")))


def count_tables(text: Column) -> Column:
    """Markdown tables: a row, then a rule line."""
    return F.regexp_count(text, F.lit(r"\|.*\|.*\n\|[-:| ]+\|")).cast("long")


def latin1(text: Column) -> Column:
    """Characters outside Latin-1 replaced by their likes, others by a question mark."""
    out = reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), C.LATIN1, text)
    return F.regexp_replace(out, "[^\\x{00}-\\x{ff}]", "?")


def project_slug(name: Column) -> Column:
    """Lower-cased words joined by hyphens."""
    plain = F.regexp_replace(F.lower(name), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[-\s]+", "-"), "^-+|-+$", "")


def first_sentence(text: Column, cap: int = 200) -> Column:
    """The first sentence if short, else the whole text if short, else cut."""
    clean = squeeze(text)
    end = F.instr(clean, ". ") - 1
    return F.when((end > 0) & (end < cap), F.substring(clean, F.lit(1), end + 1)).when(F.length(clean) <= cap, clean).otherwise(truncate_at_sentence(clean, cap))


def snippet_value(fields: Column, extracted: Column, text: Column) -> Column:
    """A snippet's value: a known field, else the first field that is not blank by name, else the extracted value, else
    the first sentence."""
    known = [F.nullif(fields[k], F.lit("")) for k in C.VALUE_KEYS]
    filled = F.array_sort(F.filter(F.map_entries(fields), lambda e: F.trim(e["value"]) != ""))
    any_field = F.when(F.size(filled) > 0, F.get(filled, 0)["value"])
    return F.coalesce(*known, any_field, F.nullif(extracted, F.lit("")), F.when(text != "", first_sentence(text)), F.lit("_No value extracted_"))


def crediting_period(start: Column, end: Column, text: Column) -> Column:
    """Structured dates, else "n years" with a date range if there is one, else a range of years."""
    years = found(text, r"(?i)(\d+)\s*[-–]?\s*years?")
    span = r"(\d{2}/\d{2}/\d{4})\s*(?:to|-|–)\s*(\d{2}/\d{2}/\d{4})"
    a, b = found(text, span, 1), found(text, span, 2)
    pair = r"(\d{4})\s*(?:to|-|–)\s*(\d{4})"
    return F.coalesce(
        F.concat(F.nullif(start, F.lit("")), F.lit(" to "), F.nullif(end, F.lit(""))), F.concat(years, F.lit(" years ("), a, F.lit(" to "), b, F.lit(")")),
        F.concat(years, F.lit(" years")), F.concat(found(text, pair, 1), F.lit(" to "), found(text, pair, 2)), F.lit("_Not specified_"),
    )


def duration(seconds: Column) -> Column:
    """"5 seconds", "1 minute", "2h 5m"."""
    m = F.floor(seconds / 60)
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" seconds")))
        .when(m < 60, F.concat(m.cast("string"), F.lit(" minute"), F.when(m != 1, "s").otherwise("")))
        .otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h "), F.pmod(m, F.lit(60)).cast("string"), F.lit("m")))
    )


def fenced_json(reply: Column) -> Column:
    """JSON in a model's reply: a json fence, else any fence, else the whole."""
    return F.trim(F.coalesce(found(reply, r"(?s)```json\s*(.*?)```"), found(reply, r"(?s)```\s*(.*?)```"), reply))


def flat_object(reply: Column) -> Column:
    """The first object without objects in it."""
    return found(reply, r"(\{[^{}]*\})")


def cache_key(*parts: Column) -> Column:
    """Sixteen hexadecimal digits of a hash over parts that are told apart by their place."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *(F.coalesce(p, F.lit("\u0000")) for p in parts)), 256), 1, 16)


def check_id(prefix: str, *parts: Column) -> Column:
    """A check's id from what it checks, so that a second run gives the same."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8))
