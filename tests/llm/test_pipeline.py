"""The pipeline's stages, one after the other, against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docengine.llm import decontaminate, quality_rules, queries
from tests.llm.test_dedup import brute_join, words


def taken_out(rows, n=50):
    """The texts without the bytes that a string of n bytes of a document with a smaller id covers."""
    least = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - n + 1):
            least[b[i : i + n]] = min(least.get(b[i : i + n], d), d)
    out = []
    for d, t in rows:
        b, gone, end = t.encode(), bytearray(len(t.encode())), 0
        for i in range(len(b) - n + 1):
            if least[b[i : i + n]] < d:
                for j in range(max(i, end), i + n):
                    gone[j] = 1
                end = i + n
        out.append((d, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return out


@pytest.fixture
def small(spark, tmp_path, sf_dir):
    """Documents with copies, near copies, shared passages, a benchmark item and junk; the benchmark's own table."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) BETWEEN 400 AND 4000").orderBy("doc_id").limit(40).collect()
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 40").orderBy("item_id").first()["text"]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in base]
    text = rows[0][1]
    own = [text, text + " end", item.join((rows[1][1], rows[2][1])), rows[3][1][:300] + " " + rows[4][1], "", None, "few words only", "same again " * 60]
    rows += [(10_000 + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(own)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), [(d, t) for d, t, *_ in rows]


def test_pipeline_matches_brute_force(spark, small):
    sf_dir, rows = small
    rows = [(d, t) for d, t in rows if quality_rules.passes(quality_rules.View(t), quality_rules.RULES)]
    roots = {d: root for d, _, root in brute_join(rows, 5, 80)}
    rows = [(d, t) for d, t in rows if roots[d] == d]
    rows = taken_out(rows)
    items = [(r["item_id"], decontaminate.normal(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(sorted(items))
    rows = [(d, t) for d, t in rows if not matcher.find(decontaminate.normal(t))]
    library = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for d, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), ids))
    out = corpus_pipeline.run(spark, sf_dir)
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], list(r["ids"])) for r in out.collect()]
    assert sorted(got) == sorted(want) and 10 < len(got) < len(small[1])
    assert not {10_004, 10_005, 10_006, 10_007} & {d for d, *_ in got}


def test_unrelated_texts_without_an_id_all_stay(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) BETWEEN 400 AND 4000").orderBy("doc_id").limit(12).collect()]
    kept = {d for d, _, root in brute_join(list(enumerate(texts)), 5, 80) if d == root}
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert len(kept) > 1 and out.count() == len(kept)


def test_stages_keep_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet").withColumn("row", F.lit(1)).withColumn("__g", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small[0]).columns == docs.columns
    assert len(words("a b")) == 2
