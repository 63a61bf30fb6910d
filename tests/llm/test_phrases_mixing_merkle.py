"""Phrase collocations, mixing and the Merkle manifest against plain versions, on hard rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import collocations, merkle, mixing


def phrases(rows, most, least, closure, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    often = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, g), a in often.items():
        if len(g) < 2:
            continue
        longer = [v for (m, h), v in often.items() if m == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
        if any(100 * v >= closure * a for v in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, g[:j]] * f[lang, g[j:]]), j) for j in range(1, len(g))]
        score, j = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:j]], f[lang, g[j:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("least,closure,top", [(2, 100, 2000), (3, 100, 5), (2, 80, 50)])
def test_phrases_equal_plain_counts(spark, least, closure, top):
    r = random.Random(least)
    words = ["a", "B", "é", " ", "c\x1cd", "ce", "z" * 30, "\x00"]
    ends = [" ", " ", " ", "\t", ". ", "\n", "\x0b", "!", "  "]
    text = lambda n: "".join(r.choice(words) + r.choice(ends) for _ in range(n))
    rows = [(lang, text(r.randint(0, 60))) for lang in ("en", "de", None, "und", "") for _ in range(6)]
    rows += [("en", None), ("en", ""), ("en", " \n. "), ("en", rows[0][1]), ("en", rows[0][1]), ("de", text(3000)), ("x\n y", "p q p q p q")]
    docs = spark.createDataFrame([(i % 4, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").select("*", F.lit(1).alias("shard"), F.lit(2).alias("phrase"), F.lit("x").alias("word"))
    got = collocations.mine(docs, least=least, closure=closure, top=top).collect()
    assert sorted(tuple(r) for r in got) == phrases(rows, 5, least, closure, top)


def test_phrases_do_not_depend_on_shards(spark, monkeypatch):
    text = " ".join(random.Random(1).choices(["x", "y", "w."], k=4000))
    docs = spark.createDataFrame([(1, text, "en"), (2, text[:500], "en"), (3, text, "fr")], "doc_id long, text string, lang string")
    want = sorted(map(tuple, collocations.mine(docs, least=5).collect()))
    monkeypatch.setattr(collocations, "SHARD_BYTES", 600)
    monkeypatch.setattr(collocations, "BUCKET_PAIRS", 20)
    assert want and sorted(map(tuple, collocations.mine(docs, least=5).collect())) == want
    assert collocations.mine(docs.limit(0)).collect() == []


def test_positions_and_packing():
    body = np.frombuffer(b"a b.c dd  e\n.f", np.uint8)
    start, end, row, at = collocations.words_at(body, np.array([0, 9, 9, 14]))
    assert [body[a:b].tobytes() for a, b in zip(start, end)] == [b"a", b"b", b"c", b"dd", b"e", b"f"]
    assert row.tolist() == [0, 0, 0, 0, 2, 2] and at.tolist() == [0, 1, 3, 4, 6, 8]
    import pyarrow as pa

    x = np.array([0, 3, 70_000, 2**40], np.uint64)
    assert collocations.from_gaps(pa.scalar(collocations.gaps(x, np.uint64)), np.uint64).tolist() == x.tolist()


def plain_targets(sizes, weights, percent, cap):
    total, stopped = sum(sizes.values()), set()
    while True:
        left = percent * total / 100 - sum(cap * sizes[s] for s in stopped)
        rate = sum(weights[s] for s in sizes if s not in stopped)
        now = {s: left * weights[s] / rate for s in sizes if s not in stopped}
        above = {s for s, t in now.items() if t > cap * sizes[s]}
        if not above:
            return {s: now.get(s, cap * sizes[s]) for s in sizes}
        stopped |= above


def mixed_rows():
    r = random.Random(3)
    rows = [(i, " ".join("w%d" % r.randint(0, 50) for _ in range(r.randint(0, 300))), r.choice(["b", "b", "b", "a", "\U0001f600", "￿", None])) for i in range(150)]
    return rows + [(7, "x y", "tiny"), (7, "x y", "tiny"), (None, "p q\x0br", None), (None, None, "a"), (8, "", "empty"), (9, " \t", "empty"), (10, "long " * 30_000, "b")]


def test_mix_meets_targets_and_caps(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit(1).alias("size"), F.lit(2).alias("no"), F.lit("x").alias("block"))
    made = mixing.mix(docs, mixing.cycled_weights(docs, (3, 1, 2)), block_words=4, shard_slots=1000, text=True)
    got = made.documents().collect()
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=repr) == sorted(((d, n(t)) for d, t, _ in rows), key=repr)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += n(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = plain_targets(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 150, 2)
    source_of = {r["source_size"]: r["target"] for r in got}
    assert {sizes[s]: pytest.approx(want[s]) for s in sizes} == source_of
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
    for s in sizes:
        assert abs(taken[sizes[s]] - want[s]) <= 12
    again = mixing.mix(docs.repartition(7), mixing.cycled_weights(docs, (3, 1, 2)), block_words=4, shard_slots=1000).documents().collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    texts = made.texts().collect()
    assert sum(n(r["text"]) for r in texts) == sum(taken.values())
    assert len({(r["shard"], r["slot"]) for r in texts}) == len(texts) and {n(r["text"]) for r in texts} <= {1, 2, 3, 4}
    words = {s: Counter(w for _, t, x in rows if x == s for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")) for s in sizes}
    assert all(w in words[r["source"]] for r in texts for w in r["text"].split(" "))
    shards = Counter(r["shard"] for r in texts)
    assert all(c == 1000 for k, c in shards.items() if k < max(shards))


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs, mixing.cycled_weights(docs, (1,))).documents().collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, " ", "s")], "doc_id long, text string, source string")
    assert {tuple(r) for r in mixing.mix(blank, mixing.cycled_weights(blank, (1,))).documents().collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation_is_one(spark, n):
    rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.round_keys(F.lit(3), F.lit(1), F.lit(n).cast("long"))).alias("x")).collect()
    got = [r["x"] for r in rows]
    assert sorted(got) == list(range(n)) and (n < 60 or sum(a == b for a, b in enumerate(got)) < n // 8)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return levels


def refold(digest, index, levels):
    proof = []
    for level in levels[:-1]:
        run = level[index - index % 2 : index - index % 2 + 2]
        k = index % 2
        proof += run[:k] + run[k + 1 :]
        digest = h(*run[:k], digest, *run[k + 1 :])
        index //= 2
    return digest, proof


def plain_manifest(rows):
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        row = [doc_id, source, lang, n_chars, text]
        held = leaf([doc_id, source, lang, n_chars + 1, text]) if bad else leaf(row)
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), leaf(row), doc_id, held))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([g[1] for g in sorted(groups[x])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, (_, own, doc_id, held) in enumerate(sorted(groups[x])):
            folded, low = refold(held, i, trees[x])
            folded, high = refold(folded, k, top)
            out.append((doc_id, own, trees[x][-1][0], top[-1][0], h(*low, *high), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("depth", [12, 3, 2])
def test_merkle_equals_plain_trees(spark, depth):
    r = random.Random(9)
    rows = [(r.choice([None, *range(-50, 300)]), r.choice([None, "s", ""]), r.choice(["en"] * 6 + ["de", None, "", "\U0001f600", "￿"]), r.choice([None, 5, 2**63 - 1]), r.choice([None, "", "é", "-", "2:x"])) for _ in range(150 if depth < 12 else 60)]
    rows += [rows[0], rows[0], (1, "s", "one", 3, "x" * 100_000)]
    docs = spark.createDataFrame([(a, e, c, b, d) for a, b, c, d, e in rows], "doc_id long, text string, lang string, source string, n_chars long").select("*", F.lit(1).alias("tree"), F.lit(2).alias("group"), F.lit("x").alias("leaf"), F.lit(0).alias("id"))
    got = merkle.manifest(merkle.document_leaves(docs), depth).prove().collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_manifest(rows)))
    assert {r["verified"] for r in got} == {True, False}


def test_merkle_of_little(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.manifest(merkle.document_leaves(empty)).prove().collect() == []
    one = spark.createDataFrame([(4, "x", None, None, 1)], empty.schema)
    (row,) = merkle.manifest(merkle.document_leaves(one)).prove().collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h() and row["verified"]


def test_span_takes_events_in_any_order():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    want = [d.hex() for d in digests]
    for seed in range(5):
        order = list(range(11))
        random.Random(seed).shuffle(order)
        parts = [merkle.Span(11) for _ in range(3)]
        for k, i in enumerate(order):
            parts[k % 3].arrive(0, i, digests[i])
        whole = parts[0].absorb(parts[1]).absorb(parts[2])
        root = tree(want)[-1][0]
        assert whole.top[2].hex() == root
        for i, path in whole.paths():
            assert merkle.fold(digests[i], i, 11, path) == (bytes.fromhex(root), b"")
    half = merkle.Span(11).arrive(0, 1, digests[1])
    with pytest.raises(ValueError):
        list(half.paths())
