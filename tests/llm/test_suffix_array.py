"""External induced sorting against plain sorting: small memory, large alphabets, periodic texts, all depths."""

import numpy as np
import pytest

from docengine.llm import suffix_array
from docengine.llm.suffix_dedup import least_owners


def sort(x, kinds, cap, memory, levels=8):
    text = suffix_array.padded(len(x), x.dtype, cap)
    text[: len(x)] = x
    parts = list(suffix_array.suffixes(text, len(x), kinds, cap=cap, memory=memory, levels=levels))
    return tuple(np.concatenate(p).tolist() for p in zip(*parts)) if parts else ([], [])


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def plain(x, cap):
    x = x.tolist()
    order = sorted(range(len(x)), key=lambda i: x[i:], reverse=True)
    return order, [0, *(min(cap, shared(x[a:], x[b:])) for a, b in zip(order, order[1:]))][: len(x)]


def texts():
    r = np.random.default_rng(3)
    for i in range(60):
        kinds, n = int(r.integers(1, 6)), int(r.integers(0, 130))
        x = r.integers(1, kinds + 1, n)
        if i % 5 == 0:
            x = np.resize(x[:3], n) if n else x
        yield (x.astype(np.uint8), kinds) if i % 2 else ((x * 1000).astype(np.uint32), 1000 * kinds)


@pytest.mark.parametrize(("memory", "levels"), [(1 << 9, 8), (1 << 14, 8), (1 << 22, 8), (1 << 9, 2), (1 << 22, 2), (1 << 12, 1)])
def test_places_and_common_prefixes(memory, levels):
    for x, kinds in texts():
        assert sort(x, kinds, 250, memory, levels) == plain(x, 250)


@pytest.mark.parametrize("cap", [1, 3, 7, 50])
def test_sorts_by_cap_symbols(cap):
    for i, (x, kinds) in enumerate(texts()):
        places, common = sort(x, kinds, cap, 1 << 12, 1 + i % 4)
        heads = [x[p : p + cap].tolist() for p in places]
        assert heads == sorted(heads, reverse=True) and sorted(places) == list(range(len(x)))
        assert common == [0, *(shared(a, b) for a, b in zip(heads, heads[1:]))][: len(x)]


def test_large_alphabet_in_little_memory_spills(monkeypatch):
    """5,000 symbols and more names; queue tuples and pieces go to files, and the result stays the same."""
    r = np.random.default_rng(4)
    base = r.integers(1, 5001, 6000).astype(np.uint32)
    x = np.concatenate([base, base[1000:3000], r.integers(1, 5001, 2000).astype(np.uint32), base[2000:2400]])
    spilled = []
    old = suffix_array.Queue._spill
    monkeypatch.setattr(suffix_array.Queue, "_spill", lambda self: (old(self), spilled.append(self.spilled)))
    small = sort(x, 5000, 50, 1 << 12)
    assert sum(n > 0 for n in spilled) > 10
    assert small[1] == sort(x, 5000, 50, 1 << 22)[1]
    heads = [x[p : p + 50].tolist() for p in small[0]]
    assert heads == sorted(heads, reverse=True)


def test_least_owners_in_little_memory():
    r = np.random.default_rng(5)
    passage = r.integers(97, 123, 200).astype(np.uint8)
    regions, ids = [], []
    for i in range(300):
        a, b = sorted(r.integers(0, 200, 2))
        own = np.concatenate((r.integers(97, 123, 60).astype(np.uint8), passage[a:b]))[-80:]
        regions.append(own if i % 3 else np.tile(own[:2], 40))
        ids.append(int(r.integers(0, 1000)))
    sizes = np.array([len(x) for x in regions], np.uint8)
    want = {}
    for x, d in zip(regions, ids):
        for i in range(len(x) - 49):
            key = x[i : i + 50].tobytes()
            want[key] = min(want.get(key, d), d)
    for memory in (1 << 10, 1 << 24):
        starts, group, least = least_owners(np.concatenate(regions), sizes, np.array(ids), memory=memory)
        for x, at in zip(regions, starts):
            for i in range(len(x) - 49):
                assert least[group[at + i]] == want[x[i : i + 50].tobytes()]
