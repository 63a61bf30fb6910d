"""Substring dedup, suffix-array dedup and the n-gram join against brute force, on hard rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from docengine.llm import bpe, common, ngram_join, packs, substring_dedup, suffix_dedup
from docengine.llm.common import buffers, groups_for
from docengine.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def brute_substring(rows, n=35):
    windows = Counter(tuple(w[i : i + n]) for _, t in rows for w in [words(t)] for i in range(len(w) - n + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if windows[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_suffix(rows, n=50):
    key = lambda d: -(1 << 63) if d is None else d
    least = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            least[s] = min(least.get(s, key(d)), key(d))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if least[b[i : i + n]] < key(d):
                gone[i : i + n] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def brute_join(rows, n, percent):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for d, t in rows:
        w = words(fold(t))
        sets.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    key = lambda d: -(1 << 63) if d is None else d
    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(key(d)), find(key(e))
                root[max(x, y)] = min(x, y)
    back = lambda k: None if k == -(1 << 63) else k
    return sorted(((d, len(s), back(find(key(d)))) for d, s in sets), key=repr)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_substring_hard_rows(documents, hard_rows, extra):
    out = substring_dedup.digest(substring_dedup.dedup(documents(hard_rows, extra)))
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(hard_rows)


@pytest.mark.parametrize("extra", [False, True])
def test_suffix_hard_rows(documents, hard_rows, extra):
    out = suffix_dedup.digest(suffix_dedup.dedup(documents(hard_rows, extra)))
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffix(hard_rows)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_join_hard_rows(documents, hard_rows, n, percent):
    out = ngram_join.join(documents(hard_rows, True), n=n, percent=percent)
    assert got(out, "doc_id", "n_shingles", "component_id") == brute_join(hard_rows, n, percent)


@pytest.mark.parametrize("seed", range(3))
def test_join_random_near_copies(documents, seed):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(12)]
    rows = []
    for i in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randint(1, 40))]
        rows.append((2 * i, " ".join(w)))
        w[r.randrange(len(w))] = "edit"
        rows.append((2 * i + 1, " ".join(w)))
    assert got(ngram_join.join(documents(rows), n=3, percent=80), "doc_id", "n_shingles", "component_id") == brute_join(rows, 3, 80)


def test_empty_tables(documents):
    none = documents([])
    assert substring_dedup.dedup(none).count() == suffix_dedup.dedup(none).count() == ngram_join.join(none).count() == 0


def test_index_is_incremental(spark, documents, hard_rows):
    keyed = substring_dedup.with_keys(documents(hard_rows))
    marks = substring_dedup.fingerprints(keyed)
    index = substring_dedup.FingerprintIndex(spark)
    for b in range(5):
        index.add(marks.filter(f"pmod(doc_id, 5) = {b}"))
    assert len(index.runs()) < 5
    counts = Counter(r["fingerprint"] for r in marks.collect())
    assert {r["fingerprint"] for r in index.repeated().collect()} == {f for f, n in counts.items() if n > 1}
    index.close()


def test_keep_one_and_take_out(documents, hard_rows):
    docs = documents(hard_rows, True)
    kept = ngram_join.keep_one(docs, n=5, percent=80)
    assert kept.columns == docs.columns
    groups = defaultdict(set)
    for d, n, c in brute_join(hard_rows, 5, 80):
        if n:
            groups[c].add(d)
    assert sum(1 for r in kept.collect() if words(r["text"])) == len(groups)
    out = suffix_dedup.dedup_documents(docs)
    assert out.schema == docs.schema
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[7] is None and text[1] == "" and text[6] == "x "[:1] + " " + " y"[-2:] or "x" in text[6]


def test_keep_one_by_row_links_texts_alone(documents):
    r = random.Random(3)
    a, b, c, d = (" ".join(r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(40)) for _ in range(4))
    rows = [(1, a), (2, b), (None, a + " x"), (None, b + " x"), (None, c), (None, c), (7, d), (7, c + " y"), (8, d + " z"), (9, "")]
    numbered = [(i, t) for i, (_, t) in enumerate(sorted(rows, key=lambda x: -(1 << 63) if x[0] is None else x[0]))]
    groups = {root for _, n, root in brute_join(numbered, 5, 80) if n}
    kept = ngram_join.keep_one(documents(rows, True), n=5, percent=80, by_row=True)
    assert len(groups) == 4 and got(kept, "doc_id", "text") == sorted([(None, a + " x"), (None, b + " x"), (None, c), (7, d), (9, "")], key=repr)


def test_suffix_dedup_reads_all_chunks(spark, documents, monkeypatch):
    table = pa.table({"text": pa.chunked_array([["ab" * 40, None], [], ["cd", "ef" * 40]])})
    part_rows = lambda a, part, row, *_: iter([(a + row).tolist()])
    assert {r for rows in suffix_dedup._hits(table, part_rows) for r in rows} == {0, 3}
    gone, offsets = suffix_dedup._gone(table, pa.table({"keys0": pa.array([], pa.binary())}))
    assert offsets.tolist() == [0, 80, 80, 82, 162] and len(gone) == 162
    docs = documents([(i, "x" * 100) for i in range(30)])
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 100)
    assert groups_for(docs, suffix_dedup.GROUP_BYTES, 1 << 30) == [30, 4] and groups_for(documents([]), 100) == [4]
    assert sum(r["n_removed"] for r in suffix_dedup.dedup(docs).collect()) == 2900


def test_edges_of_a_hot_passage_do_not_meet_in_one_shard():
    r = random.Random(8)
    own = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    passage, n = own(150), 12000
    texts = pa.table({"text": [own(60) + passage + own(60) for _ in range(n)], "__doc_id": range(n), "__g": [0] * n})
    marks = np.concatenate([packs.sent(x[3]) for x in [suffix_dedup.window_groups(*buffers(texts.column("text").chunk(0)))]])
    values, counts = np.unique(marks, return_counts=True)
    wanted = pa.table({"fps": [packs.to_bytes(values[counts > 1])], "counts": [counts[counts > 1].astype(np.uint32).tobytes()]})
    alike = Counter()
    for row in suffix_dedup._regions(4)(texts, wanted).to_pylist():
        sizes, body = (np.frombuffer(zstandard.decompress(row[k]), form) for k, form in (("sizes", np.uint8), ("body", np.uint8)))
        ends = np.cumsum(sizes, dtype=np.int64)
        ends = np.concatenate(([0], ends[ends <= len(body)]))  # windows of hot fingerprints come last and have no bytes here
        alike.update(suffix_dedup.window_groups(body, ends)[3].tolist())
    assert alike and max(alike.values()) <= suffix_dedup.HOT


def test_hot_windows_match_brute_force(documents, hard_rows):
    r = random.Random(9)
    own = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, other = own(200), own(75)
    rows = [(i // 2, own(40) + passage[i % 3 :] + own(40) + (other if i % 4 else "")) for i in range(60)] + hard_rows
    out = suffix_dedup.digest(suffix_dedup.dedup(documents(rows), hot=8))
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffix(rows)


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnop "])
def test_only_regions_that_may_share_a_window_are_sorted(monkeypatch, letters):
    """Regions of a fingerprint that differ, cut from one passage at all places, among regions that are alone."""
    r = random.Random(len(letters))
    own = lambda n: "".join(r.choice(letters) for _ in range(n))
    passage = own(120)
    cuts = [sorted((r.randrange(121), r.randrange(121))) for _ in range(150)]
    texts = pa.array([own(30) + passage[a:b] + own(30) for a, b in cuts] + [own(90) for _ in range(150)])
    body, offsets = buffers(texts)
    row, first, last, _, runs = suffix_dedup.window_groups(body, offsets)
    assert ((runs >= 0) & (runs <= 30)).all()
    regions = {body[offsets[i] + a : offsets[i] + b + suffix_dedup.LENGTH].tobytes(): at for i, a, b, at in zip(row, first, last, runs)}
    sizes, ids = np.array([len(x) for x in regions], np.uint8), np.array([r.randrange(1000) for _ in regions])
    least, most = {}, ids + np.array([r.randrange(3) for _ in regions])
    windows = lambda x: [x[i : i + suffix_dedup.LENGTH] for i in range(len(x) - suffix_dedup.LENGTH + 1)]
    for x, d in zip(regions, ids):
        for w in windows(x):
            least[w] = min(least.get(w, d), d)
    want = {(k, i, least[w]) for k, x in enumerate(regions) for i, w in enumerate(windows(x)) if least[w] < most[k]}
    taken, plain = [], suffix_dedup.least_owners
    monkeypatch.setattr(suffix_dedup, "least_owners", lambda text, *rest: taken.append(len(text)) or plain(text, *rest))
    found = suffix_dedup.runs_of_owners(np.frombuffer(b"".join(regions), np.uint8), sizes, np.array(list(regions.values()), np.uint8), ids, most)
    assert (np.diff(found[0]) >= 0).all()
    assert {(k, i, d) for k, a, b, d in zip(*(x.tolist() for x in found)) for i in range(a, b - suffix_dedup.LENGTH + 1)} == want
    shared = Counter(w for x in regions for w in windows(x))
    meeting = sum(len(x) for x in regions if any(shared[w] > 1 for w in windows(x)))
    assert 0 < meeting <= taken[0] < 0.8 * sizes.sum()


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 9), (7, 7)]
    out = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(out[i] == 100 for i in range(100, 141)) and out[5] == out[9] == out[3] == 3


def thue_morse(n):
    """A word of n letters and its complement: their sums over powers of an odd base are equal modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_with_equal_sums_are_told_apart(documents):
    r = random.Random(11)
    left, right = (" ".join("w%d" % r.randrange(10**6) for _ in range(20)) for _ in range(2))
    rows = [(i, t) for n in (1024, 2048) for i, t in enumerate((f"{left} {thue_morse(n)[0]} {right}", f"{left} {thue_morse(n)[1]} {right}", *thue_morse(n)), 10 * n)]
    out = substring_dedup.digest(substring_dedup.dedup(documents(rows)))
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(rows)
    assert got(ngram_join.join(documents(rows), n=3, percent=90), "doc_id", "n_shingles", "component_id") == brute_join(rows, 3, 90)


def test_index_reopened_for_each_batch(spark, documents, hard_rows):
    rows, seen, path = [r for r in hard_rows if len(r[1] or "") < 5000], [], None
    for k in range(3):
        batch = rows[k::3]
        if path:
            for name, _ in index.runs():
                spark.sql(f"DROP TABLE {name}")  # a new session has no catalogue; the files stay
        index = substring_dedup.FingerprintIndex.open(spark, path) if path else substring_dedup.FingerprintIndex(spark)
        path = index.path
        out = substring_dedup.digest(index.add_documents(documents(batch, True)))
        seen += batch
        want = brute_substring(seen)
        assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted((r for r in (brute_row(seen, x) for x in batch)), key=repr)
        assert len(want) == len(seen)
    assert len(index.runs()) < 3
    index.close()


def brute_row(rows, row):
    """What brute_substring says of one of rows."""
    (at,) = [i for i, r in enumerate(rows) if r is row]
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    (found,) = [r for r in brute_substring(numbered) if r[0] == at]
    return (row[0], *found[1:])


def test_least_hash_does_not_depend_on_length():
    r = np.random.default_rng(1)
    alike = r.integers(0, 1 << 20, 28).astype(np.uint64) + np.uint64(5 << 40)
    far = np.full(3_000_000, (1 << 63) + 7, np.uint64) + np.arange(3_000_000, dtype=np.uint64) * np.uint64(1 << 30)
    for at in (0, 1, 70, (1 << 20) - 30, (1 << 20) - 5, 2_999_972):
        x = far.copy()
        x[at : at + 28] = alike
        assert common.first_least(x, 28)[at] - at == common.first_least(alike, 28)[0] == 0
    x = r.integers(0, 1 << 63, 2_200_000).astype(np.uint64) << np.uint64(1)
    got = common.first_least(x, 28)
    assert len(got) == len(x) - 27
    for i in [*range(0, 100), *range((1 << 20) - 60, (1 << 20) + 30), len(x) - 28]:
        assert got[i] == i + int(np.argmin(x[i : i + 28] >> np.uint64(20)))


def test_window_in_a_very_long_text(documents):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    window, long = [word() for _ in range(35)], [word() for _ in range(1_100_000)]
    text = " ".join([*long[:700_000], *window, *long[700_000:]])
    rows = {x["doc_id"]: x["n_removed"] for x in substring_dedup.digest(substring_dedup.dedup(documents([(1, " ".join(window)), (2, text), (3, "other " + " ".join(window[:34]))]))).collect()}
    assert rows == {1: 35, 2: 35, 3: 0}


@pytest.mark.parametrize("lost", ["_save", "sweep"])
def test_index_outlives_a_lost_session(spark, documents, monkeypatch, lost):
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(4)) for _ in range(n))
    shared = text(60)
    batches = [[(1, shared), (2, text(80))], [(3, text(80))], [(4, shared + " " + text(10))]]
    index = substring_dedup.FingerprintIndex(spark)
    path = index.path
    index.add_documents(documents(batches[0]))

    def fail(self):
        raise RuntimeError("lost")

    index = substring_dedup.FingerprintIndex.open(spark, path)
    with monkeypatch.context() as m:
        m.setattr(substring_dedup.FingerprintIndex, lost, fail)
        with pytest.raises(RuntimeError):
            index.add_documents(documents(batches[1]))
    index = substring_dedup.FingerprintIndex.open(spark, path)
    if index.batches == 1:
        index.add_documents(documents(batches[1]))
    out = {x["doc_id"]: x["n_removed"] for x in substring_dedup.FingerprintIndex.open(spark, path).add_documents(documents(batches[2])).collect()}
    assert out == {4: 60}
    index = substring_dedup.FingerprintIndex.open(spark, path)
    name, at = index.runs()[-1]
    index._drop(name, at)
    with pytest.raises(FileNotFoundError):
        substring_dedup.FingerprintIndex.open(spark, path)


def arrow(texts):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([7] * n, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text_key", "text"])


@pytest.mark.parametrize("kinds", [1, 3, 1 << 60])
@pytest.mark.parametrize("n", [3, 5])
def test_grams_of_equal_hash_are_told_apart(monkeypatch, kinds, n):
    """Sets are counted and compared by words, however few values the hashes have."""
    true = common.word_hashes
    monkeypatch.setattr(ngram_join, "word_hashes", lambda *a: true(*a) % np.uint64(kinds))
    r = random.Random(n)
    texts = [" ".join(r.choice("abcde") * r.randint(1, 2) for _ in range(r.randint(0, 30))) for _ in range(80)] + ["", None, " \t", "A b", "a B c", "a b"]
    others = [t if i % 3 == 0 else r.choice(texts) for i, t in enumerate(texts)]
    sets = lambda t: {tuple(w[i : i + n]) for w in [words((t or "").lower())] for i in range(max(len(w) - n + 1, min(len(w), 1)))}
    info = next(ngram_join._info(n)(iter([arrow(texts)])))
    assert info.column(2).to_pylist() == [len(sets(t)) for t in texts]
    marks = dict(zip(zip(*(info.column(c).to_pylist() for c in (3, 4))), (tuple(words((t or "").lower())) for t in texts)))
    assert len(marks) == len({tuple(words((t or "").lower())) for t in texts})
    sides = [ngram_join.Grams(*buffers(pa.array(x, pa.string())), n) for x in (texts, others)]
    common_n, both = ngram_join.common_grams(*sides)
    assert common_n.tolist() == [len(sets(a) & sets(b)) for a, b in zip(texts, others)]
    assert both.tolist() == [len(sets(a)) + len(sets(b)) for a, b in zip(texts, others)]


@pytest.mark.parametrize("kinds", [1, 2])
def test_windows_of_equal_hash_are_told_apart(monkeypatch, kinds):
    """A sequence's digest is that of its words, however few values the hashes have."""
    true = common.word_hashes
    monkeypatch.setattr(substring_dedup, "word_hashes", lambda *a: true(*a) % np.uint64(kinds))
    r = random.Random(kinds)
    base = [r.choice("abcdef") for _ in range(80)]
    rows = [base, base[10:60], base[:40] + ["x"] + base[41:], ["ab"] + base[1:], base[5:20], []]
    w = substring_dedup.Windows(*buffers(pa.array([" \n".join(x) for x in rows])))
    row, first, last, _, data = w.groups()
    got = {}
    for i, (d, a, b) in enumerate(zip(row.tolist(), first.tolist(), last.tolist())):
        got.setdefault(data[16 * i : 16 * i + 16].tobytes(), set()).add(tuple(rows[d][a : b + 35]))
    assert all(len(x) == 1 for x in got.values()) and len(got) == len({x for s in got.values() for x in s})
    singles = w.sequences(w.starts, w.starts + 35).reshape(-1, 16)
    at = [tuple(rows[d][i : i + 35]) for d in range(len(rows)) for i in range(len(rows[d]) - 34)]
    assert len({(x.tobytes(), t) for x, t in zip(singles, at)}) == len({x.tobytes() for x in singles}) == len(set(at))
