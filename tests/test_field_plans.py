"""What the queries of extracted fields move: order lines are dealt out by session once, the nine fields of each line never."""

import re

import pytest

from docengine.operators import evidence, validation
from docengine.plans import registry

#: How often rows made of fields are moved on a small table: summaries of groups, and the names of fields with several.
MOVES = {
    "str10_structural_checks": 0,
    "agg15_layer_summary": 2,
    "agg10_last_by_document": 0,
    "crd01_session_validation": 2,
    "idx01_check_ids": 0,
    "agg14_validation_summary": 2,
    "xdc05_cross_document": 1,
    "agg16_checks_by_type": 1,
    "str01_required_fields": 0,
    "str08_period_consistency": 0,
    "agg11_dedup_values": 0,
    "snk06_check_lines": 0,
    "agg07_merge_best": 0,
    "xdc01_date_alignment": 0,
}


def moves(df) -> int:
    """Exchanges of the plan above a Generate, which makes fields of lines."""
    above, n = [], set()
    for i, line in enumerate(df._jdf.queryExecution().executedPlan().toString().splitlines()):
        depth = len(re.match(r"[\s:+|-]*", line)[0])
        while above and above[-1][0] >= depth:
            above.pop()
        above.append((depth, i, line))
        if "Generate explode" in line:
            n |= {k for _, k, x in above if re.search(r"\bExchange\b", x)}
    return len(n)


@pytest.mark.parametrize("name", sorted(MOVES))
def test_fields_stay(spark, sf_dir, name):
    assert moves(registry.QUERIES[name](spark, sf_dir)) == MOVES[name]


def test_names_of_a_field(spark):
    rows = [("s", f"D{i}", "owner_name", v) for i, v in enumerate(["Nick", " nick", "Nicks", None])] + [("t", "D1", "owner_name", "A"), ("t", "D2", "owner_name", "a "), ("u", "D1", "owner_name", "A"), ("u", "D1", "project_id", "A"), ("v", "D1", "owner_name", "abc"), ("v", "D2", "owner_name", "xyz")]
    got = validation.name_consistency(spark.createDataFrame(rows, "session string, document string, field_name string, value string")).collect()
    assert sorted((r.session, r.status, r.flagged, r.similarity) for r in got) == [("s", "warning", True, 8 / 9), ("t", "pass", False, 1.0), ("v", "fail", True, 0.0)]


def test_last_of_a_document(spark):
    rows = [("s", "D1", "a", "1", 0.2, 5), ("s", "D1", "a", None, 0.9, 7), ("s", "D1", "b", "2", None, 3), ("s", "D2", "a", "3", 0.4, 1), ("s", None, "a", "4", 0.5, 2)]
    got = evidence.last_by_document(spark.createDataFrame(rows, "session string, document_id string, field_name string, value string, confidence double, pos long")).collect()
    assert sorted(map(str, got)) == sorted(f"Row(session='s', document_id={d!r}, field_name={f!r}, value={v!r}, confidence={c})" for d, f, v, c in (("D1", "a", None, None), ("D1", "b", "2", None), ("D2", "a", "3", 0.4)))
