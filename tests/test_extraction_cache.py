"""Extractors over chunks, canonical JSON and keys, and the cache with time to live."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions import canonical
from docengine.operators import chunking, extraction
from docengine.operators.extraction import Extractor, Field
from docengine.sources.cache import Cache, replay

FIELD = [c for c in extraction.COLUMNS if c != "source"]


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, chunk_no int, n_chunks int, chunk string")


def test_failed_chunk_is_one_row_and_the_rest_arrives(spark):
    def words(c):
        if "bad" in c.text:
            raise KeyError("bad")
        return [Field("word", w, 0.5, w) for w in c.text.split()]

    def wrong(c):
        return [1] if c.number == 0 else []

    rows = extraction.extract(chunks_of(spark, [(1, 0, 3, "a b"), (1, 1, 3, "bad"), (1, 2, 3, ""), (2, 0, 1, "c")]), Extractor("words", words), Extractor("wrong", wrong)).collect()
    got = sorted(((r["doc_id"], r["chunk_no"], r["extractor"], r["value"], r["error"], r["source"]) for r in rows), key=repr)
    a = "'int' object has no attribute 'field_type'"
    assert got == sorted([
        (1, 0, "words", "a", None, "document 1 (chunk 1/3)"), (1, 0, "words", "b", None, "document 1 (chunk 1/3)"), (1, 1, "words", None, "KeyError: 'bad'", "document 1 (chunk 2/3)"), (2, 0, "words", "c", None, "document 2"),
        (1, 0, "wrong", None, f"AttributeError: {a}", "document 1 (chunk 1/3)"), (2, 0, "wrong", None, f"AttributeError: {a}", "document 2"),
    ], key=repr)


def test_retries():
    calls = []

    def slow(c):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return [Field("x", "y")]

    chunk = extraction.Chunk(1, 0, 1, "")
    assert Extractor("slow", slow, attempts=3).run(chunk) == [Field("x", "y")] and len(calls) == 3
    calls.clear()
    with pytest.raises(TimeoutError):
        Extractor("slow", slow, attempts=2).run(chunk)
    with pytest.raises(ValueError):
        Extractor("other", lambda c: int("x"), attempts=5).run(chunk)
    with pytest.raises(ValueError):
        extraction.register(Extractor("long_words", slow))


def test_merge_removes_what_overlapping_chunks_found(spark):
    text = " ".join(f"Id{i:04d}" for i in range(900))
    docs = spark.createDataFrame([(1, text), (2, "Id0001"), (3, None)], "doc_id long, text string")
    chunks = chunking.chunk(docs, size=1000, overlap=300, whole=1200)
    e = Extractor("ids", lambda c: [Field("id", w, 0.9 if c.number % 2 else 0.8, w) for w in c.text.split() if len(w) == 6])
    found = extraction.extract(chunks, e)
    merged = extraction.merge(found).collect()
    assert found.count() > len(merged) and sorted(r["value"] for r in merged if r["doc_id"] == 1) == text.split()
    order = extraction.merge(spark.createDataFrame([(1, 1, 0, "e", "t", "v", "b", 0.5, "late", None), (1, 0, 1, "e", "t", "v", "a", 0.5, "first", None), (1, 0, 0, "e", "t", "w", "a", 0.1, None, None), (1, 2, 0, "e", "t", "w", "c", 0.7, "best", None), (1, 3, 0, "e", None, None, "d", None, None, "x")], extraction.FIELDS))
    assert {(r["value"], r["raw_text"], r["confidence"], r["n_found"], r["first_chunk"]) for r in order.collect()} == {("v", "first", 0.5, 2, 0), ("w", "best", 0.7, 2, 0)}


def test_short_pieces_and_tails():
    text = ("x" * 30 + "\n\n") + "y" * 400
    assert [(s, len(c)) for s, c in chunking.split_text(text, 100, 20, 200)] == [(0, 100), (80, 100), (160, 100), (240, 100), (320, 100), (400, 32), (412, 20)]
    with pytest.raises(ValueError):
        chunking.split_text(text, 100, 100)


def test_canonical_json_equals_the_library(spark):
    r = random.Random(2)
    texts = ["", "plain", 'a "b" \\ c', "\n\r\t\b\f\x00\x1f\x7f\x80", "é ü   ퟿  ￿", "\U0001f600\U0010ffff", None, "".join(chr(r.choice([*range(0, 300), 0x4E00, 0x1F680])) for _ in range(500))]
    numbers = [0.0, -0.0, 0.1, 1.0, 1e-05, 1.5e-07, 123456789.125, 1e7, 1.25e10, 1e15, 9.999e15, 1e16, 1.2345e22, -3e-300, 1.5e300, 0.0001, 0.00012, 0.001, 100.0, 2.0**53, -12345678.9, math.inf, -math.inf, None]
    numbers += [float(f"{r.uniform(-1, 1):.{r.randint(1, 14)}e}") * 1 if i % 2 else float(f"{r.randint(1, 99999)}e{r.randint(-30, 30)}") for i in range(200)]
    rows = [(i, texts[i % len(texts)], numbers[i % len(numbers)], i if i % 3 else None, bool(i % 2)) for i in range(len(texts) * len(numbers) // 4)]
    df = spark.createDataFrame(rows, "i int, t string, d double, n long, b boolean")
    kinds = {"zeta": ("t", T.StringType()), "alpha": ("d", T.DoubleType()), "Mid": ("n", T.LongType()), "flag": ("b", T.BooleanType())}
    got = {r["i"]: r["j"] for r in df.select("i", canonical.json_object({k: (F.col(c), t) for k, (c, t) in kinds.items()}).alias("j")).collect()}
    for i, t, d, n, b in rows:
        assert got[i] == json.dumps({"zeta": t, "alpha": d, "Mid": n, "flag": b}, sort_keys=True)
    assert df.limit(1).select(canonical.json_object({})).first()[0] == "{}"
    with pytest.raises(TypeError):
        canonical.json_value(F.col("x"), T.DateType())


def test_request_keys_equal_plain_ones(spark):
    rows = [("REQ-001", 'Text "é"\n', "maps", "DOC-1", "content é", "m-1", 0.0, "v2", "cross_document"), ("REQ-002", "", "", "D", "", "m", 1e-05, "v3", "doc")]
    names = ["requirement_id", "requirement_text", "accepted_evidence", "document_id", "content", "model", "temperature", "prompt_version", "validation_type"]
    df = spark.createDataFrame(rows, names)
    got = [r[0] for r in df.select(canonical.request_key(*(F.col(c) for c in names))).collect()]
    want = []
    for row in rows:
        d = dict(zip(names, row))
        kind, content = d.pop("validation_type"), d.pop("content")
        d["document_hash"] = hashlib.sha256(content.encode()).hexdigest()[:16]
        want.append(hashlib.sha256(json.dumps(d, sort_keys=True).encode()).hexdigest()[:16] + "_" + kind[:4])
    assert got == want


@pytest.fixture
def cache(spark, tmp_path):
    return Cache(spark, str(tmp_path / "cache"), "pdf", ttl=100)


def keyed(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def values(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_second_run_computes_nothing(spark, cache):
    counted = spark.sparkContext.accumulator(0)

    def compute(missing):
        def run(batches):
            for b in batches:
                counted.add(len(b))
                yield b.assign(value=[json.dumps({"of": k}) for k in b["key"]])

        return missing.select("key").mapInPandas(run, "key string, value string")

    requests = keyed(spark, "a", "b", "a", None)
    want = {"a": '{"of": "a"}', "b": '{"of": "b"}', None: None}
    first = cache.get_or_compute(requests, compute, now=1000)
    assert values(first) == want and first.count() == 4 and counted.value == 2
    assert values(cache.get_or_compute(requests, compute, now=1050)) == want and counted.value == 2
    assert values(cache.get_or_compute(keyed(spark, "b", "c"), compute, now=1090)) == {"b": '{"of": "b"}', "c": '{"of": "c"}'} and counted.value == 3
    cache.get_or_compute(requests, compute, now=1100.5)
    assert counted.value == 5


def test_expiry_corruption_deletion_and_compaction(spark, cache):
    assert values(cache.get(keyed(spark, "a"))) == {"a": None} and cache.clear() == 0
    cache.set(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "{broken"), ("d", "4")], "key string, value string"), now=0)
    cache.set(spark.createDataFrame([("a", '"new"')], "key string, value string"), ttl=500, now=50)
    cache.delete(keyed(spark, "d"), now=60)
    asked = keyed(spark, "a", "b", "c", "d", "e")
    assert values(cache.get(asked, now=100)) == {"a": '"new"', "b": "2", "c": None, "d": None, "e": None}
    assert values(cache.get(asked, now=100.1)) == {"a": '"new"', "b": None, "c": None, "d": None, "e": None}
    wrong = spark.createDataFrame([("0" * 64, "b", "9", 90.0, 100, False, 1)], "key_hash string, key string, value string, cached_at double, ttl long, deleted boolean, at long")
    cache._append(wrong)
    assert values(cache.get(keyed(spark, "b"), now=95)) == {"b": "2"}
    (spark._jvm.java.io.File(f"{cache.folder}/set-torn")).mkdirs()
    wrong.write.mode("overwrite").parquet(f"{cache.folder}/set-torn")
    spark._jvm.java.io.File(f"{cache.folder}/set-torn/_SUCCESS").delete()
    before = values(cache.get(asked, now=99))
    cache.compact(now=99)
    assert values(cache.get(asked, now=99)) == before == {"a": '"new"', "b": "2", "c": None, "d": None, "e": None}
    assert cache.entries().count() == 2 and values(cache.get(keyed(spark, "a"), now=549)) == {"a": '"new"'}
    other = Cache(spark, cache.path, "gis")
    assert values(other.get(keyed(spark, "a"), now=99)) == {"a": None}
    assert cache.clear() == 2 and values(cache.get(keyed(spark, "a"), now=99)) == {"a": None}


def test_replayed_calls(spark):
    log = [("n", "k", 1, 0.0, "get", None, None), ("n", "k", 2, 1.0, "set", 10, "x"), ("n", "k", 3, 11.0, "get", None, None), ("n", "k", 4, 11.5, "get", None, None), ("n", "k", 5, 12.0, "set", None, "y"), ("n", "k", 6, 9e9, "get", None, None), ("n", "k", 7, 9e9, "delete", None, None), ("n", "k", 8, 9e9, "get", None, None), ("m", "k", 9, 0.0, "get", None, None)]
    rows = replay(spark.createDataFrame(log, "namespace string, key string, seq long, at double, call string, ttl long, value string")).collect()
    assert {r["seq"]: r["value"] for r in rows} == {1: None, 3: "x", 4: None, 6: "y", 8: None, 9: None} and {r["seq"] for r in rows if r["hit"]} == {3, 6}


def test_prompts_stay_within_their_budget(spark):
    from docengine.operators import prompts

    budget = prompts.Budget(document=300, instructions=50, output=20, total=1200)
    r = random.Random(3)
    rows = [("g", i, f"d{i}", ("p" * r.randint(1, 120) + "\n\n") * r.randint(1, 6)) for i in range(30)] + [("one", 0, "big", "x" * 5000), ("tie", 1, "b", "B"), ("tie", 1, "a", "A"), ("tie", 0, "c", None)]
    parts = spark.createDataFrame(rows, "k string, pos int, name string, text string")
    requests = spark.createDataFrame([("g", "i" * 90, "o" * 90), ("one", "i", "o"), ("tie", None, "o"), ("none", "i", None)], "k string, instructions string, output string")
    got = {x["k"]: x for x in prompts.assembled(requests, parts, ("k",), budget).collect()}
    assert all(len(x["prompt"]) <= 1200 for x in got.values()) and got.keys() == {"g", "one", "tie", "none"}
    assert got["g"]["prompt"].startswith("i" * 50 + "\n\n## d0\n") and got["g"]["prompt"].endswith("\n\n" + "o" * 20) and 1 < got["g"]["n_parts"] < 30
    assert "_[showing first 300 of 5008 chars]_" in got["one"]["prompt"] and got["none"]["prompt"] == "i\n\n\n\n" and got["none"]["n_parts"] == 0
    assert got["tie"]["prompt"] == "\n\n## a\nA\n## b\nB\n\n\no"
