"""Checks of merged fields and across documents. Each check is a table of one shape, so that layers are unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine import constants as C
from docengine.functions import text as T
from docengine.functions.fuzzy import best_windows, ratio_column, surname_column


def truthy(value: Column, value_type: Column) -> Column:
    """Present and neither empty, nor a number zero, nor false."""
    zero = value_type.isin("int", "float") & (value.try_cast("double") == 0)
    false = (value_type == "bool") & (F.lower(value) == "false")
    return F.coalesce(value.isNotNull() & (value != "") & ~zero & ~false, F.lit(False))


def _exploded(df: DataFrame, checks: list[tuple[Column, str, Column, Column]]) -> DataFrame:
    """A row for each check (field_name, check_type, status, flagged) with a status, from one projection of df's rows."""
    # each status is worked out once, in a projection of its own
    found = df.select("session", *(c.alias(f"{k}_{i}") for i, (n, _, s, flag) in enumerate(checks) for k, c in (("name", n), ("status", s), ("flag", flag))))
    at = lambda k, i: F.col(f"{k}_{i}")
    made = [F.when(at("status", i).isNotNull(), F.struct(F.lit(t).alias("check_type"), at("name", i).alias("field_name"), at("status", i).alias("status"), at("flag", i).alias("flagged"))) for i, (_, t, _, _) in enumerate(checks)]
    return found.select("session", F.explode(F.array(*made)).alias("c")).filter("c IS NOT NULL").select("session", "c.*")


def _row_rules(as_of_year: int) -> dict[str, tuple[str, Column]]:
    """For each rule on one merged field its check type and status, null where it doesn't apply."""
    name, v, n, day = F.col("field_name"), F.col("value"), T.number(F.col("value")), T.iso_date(F.col("value"))
    given = v.isNotNull() & (v != "")
    # years before 1990 or too far ahead are warned of; text that is no date is passed over
    ahead = F.when(name.contains("end") | name.contains("permanence"), 50).otherwise(2)
    # whole years; a fraction is cut off a number but not read from text
    years = F.when((F.col("value_type") == "str") & ~v.rlike(r"^\s*[+-]?\d+\s*$"), None).otherwise(n.cast("long"))
    return {
        "date_format": ("format", F.when(name.isin(*C.DATE_FIELDS) & given, F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$") & day.isNotNull(), "pass").otherwise("warning"))),
        "project_id": ("format", F.when((name == "project_id") & given, F.when(v.rlike(r"^\d{4}$"), "fail").when(v.rlike(f"^{C.PROJECT_ID}$") | v.rlike(f"^{C.ALTERNATIVE_ID}$"), "pass").otherwise("warning"))),
        "date_range": ("range", F.when(name.isin(*C.RANGE_DATE_FIELDS) & day.isNotNull(), F.when((F.year(day) > as_of_year + ahead) | (F.year(day) < 1990), "warning").otherwise("pass"))),
        "percentage": ("range", F.when(name.isin(*C.PERCENTAGE_FIELDS) & v.isNotNull(), F.when(n.isNull(), "warning").when((n < 0) | (n > 100), "fail").otherwise("pass"))),
        "area": ("range", F.when(name == "area_hectares", F.when(n <= 0, "fail").when(n > 1e6, "warning").when(n.isNotNull(), "pass"))),
        "period": ("range", F.when(name.isin(*C.PERIOD_FIELDS), F.when((years <= 0) | (years > 100), "warning").when(years.isNotNull(), "pass"))),
        "owner": ("generic", F.when((name == "owner_name") & given, F.when(T.contains_any(F.lower(v), C.GENERIC_OWNER_TERMS), "fail").otherwise("pass"))),
    }


def field_checks(fields: DataFrame, as_of_year: int, *rules: str) -> DataFrame:
    """The named rules on merged fields (all without names), in one pass over them."""
    made = _row_rules(as_of_year)
    return _exploded(fields, [(F.col("field_name"), t, s, s != "pass") for t, s in (made[r] for r in rules or made)])


def session_checks(fields: DataFrame, *, presence: bool = True, periods: bool = True, sessions: DataFrame | None = None) -> DataFrame:
    """Presence: a row for each required field, a warning for each recommended one that is missing. Periods: the crediting
    period ends after it starts; a permanence period that does not is failed. Sessions without any field are those of
    sessions, if given. One aggregation by session."""
    name, v = F.col("field_name"), F.col("value")
    day = lambda *names: T.iso_date(F.coalesce(*(F.max(F.when(name == n, F.nullif(v, F.lit("")))) for n in names)))
    rules = [(n, True) for n in C.REQUIRED_FIELDS] + [(n, False) for n in C.RECOMMENDED_FIELDS]
    have = [F.max(F.when(name == n, truthy(v, F.col("value_type")))).alias(f"have_{i}") for i, (n, _) in enumerate(rules)]
    ends = [day("crediting_period_start").alias("cs"), day("crediting_period_end").alias("ce"), day("permanence_start_date", "permanence_period_start").alias("ps"), day("permanence_end_date", "permanence_period_end").alias("pe")]
    if not presence:
        fields = fields.filter(name.isin("crediting_period_start", "crediting_period_end", "permanence_start_date", "permanence_period_start", "permanence_end_date", "permanence_period_end"))
    by_session = fields.groupBy("session").agg(*(have if presence else []), *(ends if periods else []))
    if sessions is not None:
        by_session = sessions.select("session").distinct().join(by_session, "session", "left")
    checks = []
    if presence:
        for i, (n, required) in enumerate(rules):
            found = F.coalesce(F.col(f"have_{i}"), F.lit(False))
            checks.append((F.lit(n), "presence", F.when(found, "pass").otherwise("fail") if required else F.when(~found, "warning"), ~found if required else F.lit(False)))
    if periods:
        credit = F.when(F.col("ce") <= F.col("cs"), "fail").when(F.col("ce") > F.col("cs"), "pass")
        checks += [(F.lit("crediting_period"), "consistency", credit, credit != "pass"), (F.lit("permanence_period"), "consistency", F.when(F.col("pe") <= F.col("ps"), "fail"), F.lit(True))]
    return _exploded(by_session, checks)


def structural(fields: DataFrame, as_of_year: int, sessions: DataFrame | None = None) -> DataFrame:
    """All checks of merged fields: one pass over them and one aggregation by session, which share the merge before."""
    return field_checks(fields, as_of_year).unionByName(session_checks(fields, sessions=sessions))


def document_checks(by_document: DataFrame, *kinds: str) -> DataFrame:
    """Checks of a field over documents (dates, ids, numbers; all without names), from one aggregation: dates at most
    MAX_DAYS_APART, where the largest pairwise difference is max - min; one id; (max - min) / max of numbers within the
    tolerance, with max 0 only if min is 0 too. A field needs two values."""
    name, v = F.col("field_name"), F.col("value")
    day, number, own_id = F.when(name.isin(*C.ALIGNED_DATE_FIELDS), T.iso_date(v)), F.when(name.isin(*C.NUMERIC_FIELDS), T.number(v)), F.when(name == "project_id", v)
    values, checked = {"dates": day, "ids": own_id, "numbers": number}, {"dates": C.ALIGNED_DATE_FIELDS, "ids": ("project_id",), "numbers": C.NUMERIC_FIELDS}
    kinds = kinds or tuple(values)
    spread = by_document.filter(name.isin(*(n for k in kinds for n in checked[k]))).groupBy("session", "field_name").agg(*(f(values[k]).alias(f"{k}_{a}") for k in kinds for a, f in (("n", F.count), ("lo", F.min), ("hi", F.max))))
    lo, hi = F.col("numbers_lo"), F.col("numbers_hi")
    status = {
        "dates": ("date_alignment", F.when(F.date_diff("dates_hi", "dates_lo") <= C.MAX_DAYS_APART, "pass").otherwise("warning")),
        "ids": ("id_consistency", F.when(F.col("ids_lo") == F.col("ids_hi"), "pass").otherwise("fail")),
        "numbers": ("numeric_consistency", F.when(F.when(hi == 0, F.when(lo == 0, 0.0).otherwise(1.0)).otherwise((hi - lo) / hi) <= C.NUMERIC_TOLERANCE, "pass").otherwise("warning")),
    }
    checks = [(F.col("field_name"), status[k][0], F.when(F.col(f"{k}_n") >= 2, status[k][1])) for k in kinds]
    return _exploded(spread, [(n, t, s, s != "pass") for n, t, s in checks])


def name_consistency(by_document: DataFrame, names=C.NAME_FIELDS, threshold: float = C.NAME_SIMILARITY) -> DataFrame:
    """One name in any case and spacing passes; else the least similarity of two distinct names decides. A field's
    distinct names are paired, not its documents, and of a field with one name nothing."""
    key = F.lower(T.full_trim(F.col("value")))
    named = by_document.filter(F.col("field_name").isin(*names) & F.col("value").isNotNull())
    distinct = named.groupBy("session", "field_name", key.alias("name")).agg(F.min("document").alias("pos"), F.count("*").alias("n"))
    counted = distinct.withColumn("kinds", F.count("*").over(Window.partitionBy("session", "field_name")))
    one = counted.filter("kinds = 1 AND n >= 2").select("session", "field_name", F.lit("pass").alias("status"), F.lit(1.0).alias("similarity"))
    several = counted.filter("kinds > 1").select("session", "field_name", "name", "pos")
    a, b = several.alias("a"), several.alias("b")
    pairs = a.join(b, ["session", "field_name"]).filter("(a.pos < b.pos) OR (a.pos = b.pos AND a.name < b.name)")
    least = pairs.select("session", "field_name", ratio_column(F.col("a.name"), F.col("b.name")).alias("s")).groupBy("session", "field_name").agg(F.min("s").alias("similarity"))
    status = F.col("status")
    out = one.unionByName(least.withColumn("status", F.when(F.col("similarity") >= threshold, "warning").otherwise("fail")))
    return out.select("session", F.lit("name_consistency").alias("check_type"), "field_name", "status", (status != "pass").alias("flagged"), "similarity")


def cross_document(by_document: DataFrame) -> DataFrame:
    """All checks across documents; each needs values of two documents."""
    return document_checks(by_document).unionByName(name_consistency(by_document).drop("similarity"))


def summary(checks: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Counts of each session's checks; all_passed means none failed and none flagged. A session of sessions without checks
    has zeros, and has not passed."""
    count = lambda x: F.count_if(x).cast("long")
    s = F.col("status")
    out = checks.groupBy("session").agg(
        F.count("*").alias("total"), count(s == "pass").alias("passed"), count(s == "warning").alias("warnings"), count(s == "fail").alias("failed"),
        count(F.col("flagged")).alias("flagged"), (count(s == "pass") / F.count("*")).alias("pass_rate"), ((count(s == "fail") == 0) & (count(F.col("flagged")) == 0)).alias("all_passed"),
    )
    if sessions is None:
        return out
    return sessions.select("session").distinct().join(out, "session", "left").fillna(0).fillna({"all_passed": False})


SYNTHESIS = "coherence_score double, compliance_status string, flags_for_review array<string>, reasoning string"


def _once(value: Column, fn) -> Column:
    """fn of a value that is worked out once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), 0)


def synthesis_result(reply: Column) -> Column:
    """A model's judgement of a session, from its reply: the object in a json fence, else the whole reply, else the first object
    without objects in it. Without a reply or an object in it, the result is unavailable and says why; then, and where the
    reply has none, there are no flags."""
    sound = lambda c: F.try_parse_json(c).isNotNull()

    def judged(good: Column, reply: Column, parsed: Column) -> Column:
        error = F.when(reply.isNull(), "no reply").when(~good, "no JSON object in the reply")
        flags = F.coalesce(parsed["flags_for_review"], F.array().cast("array<string>"))
        return F.struct(good.alias("available"), *(parsed[c].alias(c) for c in ("coherence_score", "compliance_status", "reasoning")), flags.alias("flags_for_review"), error.alias("error"))

    def read(reply: Column, fenced: Column, flat: Column) -> Column:
        chosen = F.when(fenced != "", fenced).when(sound(reply), reply).when((flat != "") & sound(flat), flat)
        is_object = lambda c: F.coalesce(sound(c) & c.rlike(r"\A\s*\{"), F.lit(False))
        return _once(chosen, lambda c: _once(is_object(c), lambda good: _once(F.from_json(F.when(good, c), SYNTHESIS), lambda parsed: judged(good, reply, parsed))))

    fence, flat = r"(?s)```json\s*(\{.*?\})\s*```", r"(\{[^{}]*\})"
    return _once(reply, lambda r: _once(F.regexp_extract(r, fence, 1), lambda fenced: _once(F.when(fenced == "", F.regexp_extract(r, flat, 1)), lambda f: read(r, fenced, f))))


def layer_summary(structural: DataFrame, cross: DataFrame, synthesis: DataFrame) -> DataFrame:
    """Counts of each session's checks over both rule layers, with the flags of its synthesis (session, result) among those
    flagged. A session without a synthesis has none available."""
    layered = structural.withColumn("layer", F.lit(1)).unionByName(cross.withColumn("layer", F.lit(2)))
    count = lambda x: F.count_if(x).cast("long")
    s, layer = F.col("status"), F.col("layer")
    out = layered.groupBy("session").agg(
        F.count("*").alias("total"), count(s == "pass").alias("passed"), count(s == "warning").alias("warnings"), count(s == "fail").alias("failed"), count(F.col("flagged")).alias("flags"),
        count(layer == 1).alias("structural_checks"), count(layer == 2).alias("cross_document_checks"),
    )
    judged = synthesis.select("session", F.size("result.flags_for_review").cast("long").alias("more"), F.col("result.available").alias("available"))
    out = out.join(judged, "session", "left").withColumn("flagged", F.col("flags") + F.coalesce("more", F.lit(0)))
    return out.select(
        "session", "total", "passed", "warnings", "failed", "flagged", (F.col("passed") / F.col("total")).alias("pass_rate"), "structural_checks", "cross_document_checks",
        F.coalesce("available", F.lit(False)).alias("synthesis_available"), ((F.col("failed") == 0) & (F.col("flagged") == 0)).alias("all_passed"),
    )


def pairwise_dates(a: Column, b: Column, max_days: int = C.MAX_DAYS_APART) -> Column:
    """Days between two dates, and pass or fail."""
    days = F.abs(F.date_diff(a, b))
    return F.struct(days.alias("days"), F.when(days <= max_days, "pass").otherwise("fail").alias("status"))


def land_tenure(records: DataFrame) -> DataFrame:
    """Owner names, areas and kinds of tenure of a session's records: pass without a discrepancy or with fewer than two
    records, a warning if only the kinds differ, else fail. Distinct names are paired."""
    names = records.groupBy("session", F.lower(T.full_trim(F.col("owner_name"))).alias("name")).agg(F.min("pos").alias("pos"))
    a, b = names.alias("a"), names.alias("b")
    pairs = a.join(b, "session").filter("(a.pos < b.pos) OR (a.pos = b.pos AND a.name < b.name)")
    least = pairs.select("session", surname_column(F.col("a.name"), F.col("b.name")).alias("s")).groupBy("session").agg(F.min("s").alias("s"))
    all_of = records.groupBy("session").agg(F.count("*").alias("n"), F.min("area_hectares").alias("lo"), F.max("area_hectares").alias("hi"), F.count_distinct("tenure_type").alias("kinds"))
    out = all_of.join(least, "session", "left").withColumn("similarity", F.coalesce("s", F.lit(1.0)))
    area = F.coalesce((F.col("hi") > 0) & ((F.col("hi") - F.col("lo")) / F.col("hi") >= 0.05), F.lit(False))
    name, kind = F.col("similarity") < C.NAME_SIMILARITY, F.col("kinds") > 1
    status = F.when((F.col("n") < 2) | ~(name | area | kind), "pass").when(~name & ~area, "warning").otherwise("fail")
    return out.select("session", "n", "similarity", status.alias("status"), ((status != "pass") | (F.col("similarity") < 1)).alias("flagged"))


def project_ids(occurrences: DataFrame, min_occurrences: int = 3, min_documents: int = 3) -> DataFrame:
    """The most frequent id of a session, of equal ones the first seen, and what is wrong with the ids found."""
    per_id = occurrences.groupBy("session", "project_id").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    primary = per_id.groupBy("session").agg(F.min_by("project_id", F.struct((-F.col("c")).alias("c"), "first")).alias("primary_id"), F.count("*").alias("kinds"), F.sum("c").alias("n"), F.count_if(~F.col("project_id").rlike(f"^{C.PROJECT_ID}$")).alias("bad"))
    spread = occurrences.groupBy("session").agg(F.count_distinct("document_id").alias("documents"))
    out = primary.join(spread, "session")
    issues = F.concat_ws("; ", F.when(F.col("bad") > 0, "invalid pattern"), F.when(F.col("kinds") > 1, "several ids"), F.when(F.col("n") < min_occurrences, "few occurrences"), F.when(F.col("documents") < min_documents, "few documents"))
    status = F.when(issues == "", "pass").when((F.col("kinds") == 1) & (F.col("bad") == 0), "warning").otherwise("fail")
    return out.select("session", "primary_id", F.col("kinds").cast("long").alias("n_ids"), F.col("n").cast("long").alias("n_occurrences"), F.col("documents").cast("long").alias("n_documents"), issues.alias("issues"), status.alias("status"))


#: White space that is stripped from a quote: what Unicode calls so and the separators of files to units. Fixed values.
BLANK = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def verified_citations(claims: DataFrame, least: float = 75.0) -> DataFrame:
    """claims (key columns, quote, source) with verified, score and snippet in place of quote and source. Nothing to look for
    or in scores 0; a quote that its source holds, in any case and but for white space at its ends, 100, and is its own
    snippet; a source shorter than a window of one and a half of the quote's length scores 0. Only the rest leaves the JVM
    for the search of its best window."""
    keys = [c for c in claims.columns if c not in ("quote", "source")]
    q, s = F.coalesce("quote", F.lit("")), F.coalesce("source", F.lit(""))
    exact = F.lower(s).contains(F.lower(F.regexp_replace(q, f"\\A{BLANK}+|{BLANK}+\\z", "")))
    none = (q == "") | (s == "")
    kind = F.when(none, "none").when(exact, "exact").when(F.length(s) < F.floor(F.length(q) * 1.5), "none").otherwise("search")
    rows = claims.withColumn("kind", kind)
    settled = rows.filter("kind <> 'search'").select(*keys, F.when(F.col("kind") == "exact", 100.0).otherwise(0.0).alias("score"), F.when(F.col("kind") == "exact", F.col("quote")).otherwise("").alias("snippet"))
    searched = best_windows(rows.filter("kind = 'search'").drop("kind"), "quote", "source").select(*keys, "score", "snippet")
    return settled.unionByName(searched).select(*keys, (F.col("score") >= least).alias("verified"), "score", "snippet")


def adjusted_confidence(confidence: Column, citation: Column, score: Column) -> Column:
    """Halved without a citation, less 0.3 if its verification fails, else unchanged."""
    none = F.coalesce(T.full_trim(citation), F.lit("")) == ""
    return F.struct(
        F.when(none, confidence * 0.5).when(score < 75, F.greatest(F.lit(0.0), confidence - 0.3)).otherwise(confidence).alias("confidence"),
        F.when(none, "no_citation").when(score < 75, "failed").otherwise("verified").alias("verification"),
    )
