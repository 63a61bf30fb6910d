"""JSON in one canonical form as a column: keys sorted, a blank after colons and commas, everything beyond ASCII escaped, and
numbers as decimals. Equal values give equal texts, so that hashes of them can be keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters with a short escape. Fixed values of the format.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _escaped(run: Column) -> Column:
    """Characters of which none is printable ASCII: the hexadecimal digits of their UTF-16 units, or a short escape."""
    out = F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(....)", r"\\u$1")
    for c, short in SHORT.items():
        if not " " <= c <= "~":
            out = F.replace(out, F.lit(f"\\u{ord(c):04x}"), F.lit(short))
    return out


def json_text(text: Column) -> Column:
    """A string; null becomes null's word. A text is escaped by runs of printable ASCII and of other characters."""
    plain = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    runs = F.regexp_extract_all(text, F.lit("[ -~]+|[^ -~]+"), F.lit(0))
    other = F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"\A[ -~]"), plain(x)).otherwise(_escaped(x))), "")
    body = F.when(text.rlike(r"\A[ -~]*\z"), plain(text)).otherwise(other)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def _shortened(x: Column) -> Column:
    """The JVM's decimals of a positive double, which may have a digit too many: one less, rounded, if that is the same number."""
    text = x.cast("string")
    mantissa, power = F.regexp_extract(text, r"^[\d.]+", 0), F.regexp_extract(text, "E.*$", 0)
    point, digits = F.instr(mantissa, ".") - 1, F.replace(mantissa, F.lit("."), F.lit(""))
    less = F.lpad(F.floor((digits.try_cast("decimal(30,0)") + 5) / 10).cast("string"), F.length(digits) - 1, "0")
    made = F.regexp_replace(F.concat(F.substring(less, F.lit(1), point), F.lit("."), F.substring(less, point + 1, F.length(less))), r"(?<=\.\d{1,20})0+$", "")
    shorter = F.concat(made, power)
    return F.when((F.length(digits) > point + 1) & (shorter.try_cast("double") == x), shorter).otherwise(text)


def json_double(x: Column) -> Column:
    """A double by its shortest decimals: without exponent from 0.0001 to below 1e16, else with one of two digits or more."""
    text = _shortened(F.abs(x))
    mantissa, power = F.regexp_extract(text, r"^([\d.]+)E", 1), F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0$", "")
    zeros = lambda n: F.repeat(F.lit("0"), n.cast("int"))
    n = F.length(digits)
    whole = F.when(n > power + 1, F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n))).otherwise(F.concat(digits, zeros(power + 1 - n), F.lit(".0")))
    small = F.concat(F.lit("0."), zeros(-power - 1), digits)
    sign = F.when(power < 0, "-").otherwise("+")
    far = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), sign, F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    made = F.when(power.isNull(), text).when(power.between(0, 15), whole).when(power.between(-4, -1), small).otherwise(far)
    minus = F.when((x < 0) | (F.startswith(x.cast("string"), F.lit("-"))), "-").otherwise("")
    names = F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(minus, F.lit("Infinity")))
    return F.coalesce(names, F.concat(minus, made), F.lit("null"))


def json_value(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return json_text(value)
    if isinstance(kind, T.DoubleType):
        return json_double(value)
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return F.coalesce(value.cast("string"), F.lit("null"))
    raise TypeError(f"no canonical form for {kind}")


def json_object(fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    """An object of strings, doubles, integers and booleans."""
    parts: list[Column] = []
    for i, (name, (value, kind)) in enumerate(sorted(fields.items())):
        parts += [F.lit(f'{", " if i else "{"}"{name}": '), json_value(value, kind)]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def request_key(requirement_id: Column, requirement_text: Column, accepted_evidence: Column, document_id: Column, content: Column, model: Column, temperature: Column, prompt_version: Column, validation_type: Column) -> Column:
    """The key of one extraction: 16 hexadecimal digits of what it depends on, and four letters of its kind of validation."""
    string, number = T.StringType(), T.DoubleType()
    text = json_object({
        "requirement_id": (requirement_id, string), "requirement_text": (requirement_text, string), "accepted_evidence": (accepted_evidence, string), "document_id": (document_id, string),
        "document_hash": (F.substring(F.sha2(content.cast("binary"), 256), 1, 16), string), "model": (model, string), "temperature": (temperature, number), "prompt_version": (prompt_version, string),
    })
    return F.concat(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), F.lit("_"), F.substring(validation_type, 1, 4))
