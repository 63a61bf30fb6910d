"""The other training-data operators: exact round trips, brute force, held-out accuracy, hard rows."""

import base64
import hashlib
import json
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docengine.llm import bpe, chat_format, decontaminate, language_id, quality_rules, queries, url_filters, warc
from docengine.llm.common import table

RULES = queries.URL_RULES


def brute_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_url_rules_and_trees(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hard = [(-1, None), (-2, ""), (-3, "http://A.B.EXAMPLE.NET/en/x?y=1"), (-4, "https://net"), (-5, "https://net/"), (-6, "x://planet/"), (-7, "http://example.com/de/" + "a1" * 5000), (-8, "http://x.org/fr/#f"), (-9, "http://É.org/fr/"), (-9, "http://É.org/fr/"), (None, "http://a.net/q")]
    both = pages.union(spark.createDataFrame(hard, "page_id long, url string")).select("*", F.lit(1).alias("host"), F.lit(2).alias("features"))
    out = url_filters.filter_urls(both, RULES)
    rows = out.collect()
    urls = sorted(both.select("page_id", "url").collect(), key=repr)
    assert len(rows) == len(urls)
    want = sorted(((r["page_id"], *brute_rule(r["url"])) for r in urls), key=repr)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in rows), key=repr) == want
    assert {r["verdict"] for r in rows if r["rule"] is None} <= {"allow", "block"}


def test_url_trees_learn(spark):
    rows = [(f"http://{'win' if i % 2 else 'calm'}{i}.com/{'?a=1&b=2' if i % 2 else 'page'}", "block" if i % 2 else "allow") for i in range(200)]
    model = url_filters.fit(spark.createDataFrame(rows, "url string, verdict string"))
    new = spark.createDataFrame([(1, "http://win999.com/?a=7&b=1"), (2, "http://calm999.com/page")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge(new, [], model).collect()} == {1: "block", 2: "allow"}
    none = url_filters.fit(spark.createDataFrame([], "url string, verdict string"))
    assert {r["verdict"] for r in url_filters.judge(new, [], none).collect()} == {"allow"}


def test_quality_measures(documents, hard_rows):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.score_documents(documents(hard_rows, True)).collect()}
    want = set()
    for d, t in hard_rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        rep = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 5000 else None
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        if rep is not None:
            want.add((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep)))
    assert want <= got


def test_cascade_order_does_not_matter(documents, hard_rows):
    docs = documents(hard_rows, True)
    kept = quality_rules.filter_documents(docs)
    assert kept.schema == docs.schema
    want = sorted((d for d, t in hard_rows if quality_rules.passes(quality_rules.View(t), quality_rules.RULES)), key=repr)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == want
    assert quality_rules.filter_documents(documents([])).count() == 0
    assert {r.name for r in quality_rules.plan_order(docs)} == {r.name for r in quality_rules.RULES}


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, hit = out.count(), out.filter("lang = lang_pred").count()
    assert n > 100 and hit / n > 0.98


def test_language_hard_rows(documents, hard_rows):
    rows = {r["doc_id"]: r for r in language_id.identify(documents(hard_rows, True)).collect()}
    assert rows[7]["lang_pred"] == rows[8]["lang_pred"] == rows[9]["lang_pred"] == "und" and rows[7]["score"] == 0
    assert rows[1]["lang_pred"] == "en" and 0 <= rows[1]["score"] <= 1
    assert {r["lang_pred"] for r in language_id.predict(documents([(1, "abc")]).withColumn("held_out", F.lit(True)), {}).collect()} == {"und"}
    assert language_id.identify(documents([])).count() == 0


def test_chat_round_trip(spark):
    r = random.Random(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\x", "\\e", "<", "[", "\n", " ", "é", "a", "<<SYS>>"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool<s>", None]), None if r.random() < 0.1 else "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for c in range(40) for t in range(r.randint(1, 5))]
    rows += [(None, 1, "user", "x"), (99, None, "user", "late"), (99, 0, "assistant", "y"), (50, 0, "user", "long " * 50_000), (51, 1, "user", "same"), (51, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    back = {x["conv_id"]: x for x in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [x[1:] for x in turns]
        assert back[c]["loss_text"] == "".join(x[2] for x in turns if x[1] == "assistant")


def test_chat_machine(spark):
    rows = [(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (2, 0, "assistant"), (3, 0, "user"), (3, 1, "user"), (4, 0, "system"), (5, 0, "user")]
    df = spark.createDataFrame([(*x, "t") for x in rows], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["valid"] for r in chat_format.format_conversations(df).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}


@pytest.fixture(scope="session")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_matches_library(spark, documents, hard_rows, library):
    r = random.Random(9)
    letters = " abcdeéßñ's\n\t  0123.,!?🙂中文<|endoftext|>thethe#*$%\\"
    rows = [*hard_rows, *((100 + i, "".join(r.choice(letters) for _ in range(r.randint(0, 80))) + ("<|endoftext|>" if i % 3 == 0 else "")) for i in range(400)), (999, "a" * 5000)]
    got = {(x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in bpe.encode_documents(documents(rows, True), queries.tokenizer_path()).collect()}
    want = set()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want


def test_bpe_goes_through_shared_prefixes_once(monkeypatch, library):
    """New pieces of some texts are encoded once, in order; what they begin with in common takes no further steps."""
    r = random.Random(4)
    texts = [None, "", *("".join(r.choice([" ", "  ", "\n", "the", "thé", "ing", "er", "a", "12", "'ll", "\x1c", "\u3000", "<|endoftext|>", "🙂"]) for _ in range(r.randint(0, 60))) for _ in range(300))]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    c, seen = bpe.Codec(json.loads(bpe.load_spec(queries.tokenizer_path()))), []
    plain = c.encode_sorted
    monkeypatch.setattr(c, "encode_sorted", lambda pieces: plain(seen.extend(pieces) or pieces))
    assert list(c.encode_all(texts)) == want
    assert list(c.encode_all(texts)) == want
    assert seen == sorted(set(seen))
    for name, bound in (("TOGETHER", 100), ("REMEMBERED", 20), ("STEPS", 5), ("PAIRS", 5)):
        monkeypatch.setattr(bpe, name, bound)
    tight = bpe.Codec(json.loads(bpe.load_spec(queries.tokenizer_path())))
    assert list(tight.encode_all(texts)) == want
    assert len(tight.apart) <= 5 and len(tight.known) < 200
    begin = "antidisestablishmentarian" * 8
    visited = []

    class Ends(list):
        def __getitem__(self, state):
            visited.append(state)
            return super().__getitem__(state)

    steps, ends, shorter = c.automaton
    c.automaton = steps, Ends(ends), shorter
    pieces = [begin + x for x in ("a", "b", "c")]
    assert [list(x) for x in c.encode_sorted(pieces)] == [library.encode(x, add_special_tokens=False).ids for x in pieces]
    assert len(visited) == len(begin) + 3


def distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        cur = [i]
        for j, b in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev)


def test_decontamination(spark, documents):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    items = [(i, text(r.randint(30, 120))) for i in range(12)] + [(20, None), (21, " "), (22, "abc"), (0, None)]
    rows = [(100, None), (101, ""), (102, "none of it"), (103, "x " + items[1][1].upper().replace(" ", " \n ") + " y"), (103, "x")]
    for k, (i, t) in enumerate(items[:12]):
        for edits in (0, 2, 4, 8, 14):
            b = list(t)
            for _ in range(edits):
                at = r.randrange(len(b))
                b[at : at + 1] = r.choice([[], ["z"], [b[at], "q"]])
            rows.append((k * 10 + edits, text(200) + "".join(b) + text(100)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["distance"]) for x in decontaminate.find_contamination(documents(rows, True), bench).collect()}
    want = set()
    for i, t in items:
        p = decontaminate.normal(t)
        for d, x in rows:
            n = decontaminate.normal(x)
            if p and n and (best := distance(p, n)) <= decontaminate.budget(p):
                want.add((d, i, best))
    assert got == want
    docs = documents(rows, True)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.schema == docs.schema and clean.count() == sum(1 for d, x in rows if not any((d, i) in {(a, b) for a, b, _ in want} and distance(decontaminate.normal(t), decontaminate.normal(x)) <= decontaminate.budget(decontaminate.normal(t)) for i, t in items if t and t.strip()))
    assert decontaminate.find_contamination(documents([]), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).count() == 0


def test_decontamination_blocks(spark):
    items = spark.createDataFrame([(i, f"item number {i}") for i in range(50)], "item_id long, text string")
    parts = list(decontaminate.blocks(items, block_chars=100))
    assert len(parts) > 3 and sum(map(len, parts)) == 50


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7} body</p>" * 20) for i in range(60)] + [(100, None, None), (101, "u", ""), (None, "n", "only"), (102, "a\r\nb", "é\x00\r\n\r\n"), (103, "big", "b" * 300_000), (104, "t", "tie"), (104, "t", "tie")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("rank", F.lit(2))
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    got = sorted((tuple(r) for r in warc.read_archives(spark, path).collect()), key=repr)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -(1 << 63)), -(1 << 63) if i is None else i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = (-(1 << 63) if i is None else i) < top[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top[h or ""] if revisit else None))
    assert got == sorted(want, key=repr)


def test_warc_files_are_plain_zstandard(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    for name in (tmp_path / "w").glob("part-*"):
        data = name.read_bytes()
        if data:
            assert data[:4] == warc.DICTIONARY_MAGIC
            n = int.from_bytes(data[4:8], "little")
            d = zstandard.ZstdCompressionDict(data[8 : 8 + n])
            text = zstandard.ZstdDecompressor(dict_data=d).stream_reader(data[8 + n :], read_across_frames=True).read()
            assert text.count(b"WARC/1.1\r\n") == sum(1 for _ in warc.parse(data))
    with pytest.raises(ValueError):
        list(warc.parse(b"no dictionary"))
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_queries_match_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, sf_dir), con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        found = [tuple(r[c] for c in columns) for r in got.collect()]
        at = [want.columns.index(c) for c in columns]
        assert sorted(map(repr, found)) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall()), name


def plain_vector(encoder, text):
    """The sum over all n-grams of the product of their letters' vectors, each rolled by its place."""
    letters = encoder.placed[language_id.NGRAM - 1]
    slots = [0, *(int(encoder.slots[ord(c)]) for c in text.lower()), 0]
    slots = [x for i, x in enumerate(slots) if x or not i or slots[i - 1]]
    total = np.zeros(encoder.dimensions)
    for i in range(len(slots) - language_id.NGRAM + 1):
        bound = np.ones(encoder.dimensions)
        for k in range(language_id.NGRAM):
            bound *= np.roll(letters[slots[i + k]], language_id.NGRAM - 1 - k)
        total += bound
    return total / np.linalg.norm(total)


@pytest.mark.parametrize("piece", [1 << 18, 64, 7, 1])
def test_language_vectors_whatever_the_pieces(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    encoder = language_id.Encoder()
    for text in ("ab, c 12 déf\n\n ghi  ", "x", "  many   words of Έλληνικά and 日本 " * 9, "a" * 150 + " - " * 80 + "b"):
        assert np.allclose(encoder.vector(text), plain_vector(encoder, text))
    assert encoder.vector(" 1 2 - ") is None and encoder.vector("") is None


def test_language_verdicts_against_plain_version(documents):
    texts = {"en": "the cat and the dog went to the house", "de": "der hund und die katze gingen in das haus", "fr": "le chien et le chat sont dans la maison"}
    rows = [(i, f"{t} {'abc'[i % 3]}", lang) for i, (lang, t) in enumerate(list(texts.items()) * 6)]
    df = documents([(i, t) for i, t, _ in rows]).drop("lang").join(documents([]).sparkSession.createDataFrame([(i, lang) for i, _, lang in rows], "doc_id long, lang string"), "doc_id")
    encoder, prototypes = language_id.Encoder(), {}
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            prototypes[lang] = prototypes.get(lang, 0) + plain_vector(encoder, t)
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names])
    for r in language_id.identify(df).collect():
        cosines = matrix @ plain_vector(encoder, dict((i, t) for i, t, _ in rows)[r["doc_id"]])
        assert r["lang_pred"] == names[int(cosines.argmax())] and abs(r["score"] - cosines.max()) < 1e-4


def test_warc_archives_are_cut_and_valid(spark, tmp_path):
    path, n = str(tmp_path / "cut"), 57
    pages = spark.createDataFrame([(i, f"https://a.org/{i}", f"<p>{i % 40}</p>" * (1 + i % 3)) for i in range(n)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, path, date="2024-05-06T07:08:09Z", archive_frames=8)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    counts = []
    for f in files:
        with open(os.path.join(path, f), "rb") as file:
            records = list(warc.parse(file.read()))
        counts.append(len(records))
        for h, block in records:
            assert h["WARC-Date"] == "2024-05-06T07:08:09Z" and h["Content-Type"].startswith("application/http") and int(h["Content-Length"]) == len(block)
            assert block.startswith(b"HTTP/1.1 200 OK\r\n") and (h["WARC-Type"] == "revisit") == ("WARC-Profile" in h) == ("WARC-Refers-To" in h)
    assert sum(counts) == n and max(counts) == 7 and len(files) >= 9
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == n and got[0]["payload_bytes"] == len("<p>0</p>")


def test_empty_tables_give_no_rows(spark, documents):
    urls = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.filter_urls(urls, queries.URL_RULES).count() == 0
    assert quality_rules.score_documents(documents([])).count() == quality_rules.filter_documents(documents([])).count() == 0
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(talks).count() == 0
    assert bpe.encode_documents(documents([]), queries.tokenizer_path()).count() == 0
