"""Exact, near and passage deduplication and fingerprints against brute force and on odd rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash

from clickstack.llm import exact_dedup, passage_dedup, simhash_dedup, weighted_sampling
from clickstack.llm.suffix_array import suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_filter_merge_is_lossless():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 1 << 64, 5000, dtype=np.uint64) for _ in range(2))
    b[:500] = a[:500]
    parts = [exact_dedup.CountingQuotientFilter.build(x, np.ones(len(x), np.int64), 0) for x in (a, b)]
    parts = [exact_dedup.CountingQuotientFilter.from_row(*p.to_row()) for p in parts]
    merged = exact_dedup.CountingQuotientFilter.build(
        np.concatenate([p.fingerprints(0, 0) for p in parts]), np.concatenate([p.counts for p in parts]), 0)
    expected = collections.Counter([*a.tolist(), *b.tolist()])
    assert dict(zip(merged.fingerprints(0, 0).tolist(), merged.counts.tolist())) == expected


def test_exact_dedup_odd_rows(odd, nothing):
    rows = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(odd).collect()}
    by_id = collections.defaultdict(list)
    for r in exact_dedup.exact_dedup(odd).collect():
        by_id[r.doc_id].append(r)
    assert sum(map(len, by_id.values())) == 10 and rows
    assert by_id[3][0].kept and not by_id[1][0].kept and by_id[1][0].keep_id == 3 and by_id[1][0].group_size == 3
    assert by_id[5][0].kept and not any(r.kept for r in by_id[4]) and by_id[4][0].group_size == 3
    assert by_id[None][0].kept
    assert exact_dedup.exact_dedup(nothing).count() == 0


def brute_prints(texts):
    out = []
    for t in texts:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        out.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    return out


def brute_components(prints, bits=3):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def test_simhash_brute_force(docs, odd, nothing):
    p = docs.orderBy("doc_id").toPandas()
    prints = brute_prints(p.text)
    roots = brute_components(prints)
    got = {r.doc_id: r for r in simhash_dedup.simhash_near_dedup(docs).collect()}
    for i, f, r in zip(p.doc_id, prints, roots):
        assert got[i].fingerprint == f"{f:016x}" and got[i].component_id == p.doc_id[r]
    rows = simhash_dedup.simhash_near_dedup(odd).collect()
    assert len(rows) == 10
    blank = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {r.fingerprint for r in blank} == {"0" * 16} and {r.component_id for r in blank} == {1}
    assert simhash_dedup.simhash_near_dedup(nothing).count() == 0


@pytest.mark.parametrize("chunk,segments", [(8, 2), (2048, 3)])
def test_links_keep_every_component(spark, monkeypatch, chunk, segments):
    """Dense neighbourhoods, cut into chunks, against all pairs."""
    monkeypatch.setattr(simhash_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    values = set()
    for _ in range(6):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            values.add(base ^ sum(1 << int(f) for f in flips))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = [(r.u, r.v) for r in simhash_dedup.links(prints, 3, segments).collect()]
    assert all(((u ^ v) & (2**64 - 1)).bit_count() >= 0 for u, v in edges)
    place, parent = {v: i for i, v in enumerate(signed)}, list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in edges:
        a, b = root(place[u]), root(place[v])
        parent[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(values))] == brute_components(values)


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(1)
    for _ in range(400):
        text = [*rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)).tolist(), 0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array([]) == []


def brute_passages(rows, n=50):
    first, out = {}, []
    low = -(2**63)
    raw = [((low if i is None else i), (t or "").encode()) for i, t in rows]
    for i, b in sorted(raw):
        for a in range(len(b) - n + 1):
            first.setdefault(b[a : a + n], i)
    for i, b in raw:
        gone = bytearray(len(b))
        for a in range(len(b) - n + 1):
            if first[b[a : a + n]] < i:
                gone[a : a + n] = b"\x01" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block,hot,anchors", [(4 << 20, 4096, 1 << 18), (30_000, 2, 500)])
def test_passages_brute_force(docs, monkeypatch, block, hot, anchors):
    monkeypatch.setattr(passage_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(passage_dedup, "HOT", hot)
    monkeypatch.setattr(passage_dedup, "BUCKET_ANCHORS", anchors)
    got = passage_dedup.remove_repeats(docs, with_kept=False).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_passages(rows)


def test_passages_bounded_groups(spark, monkeypatch):
    """A line that many documents share, each with own text around it, never makes one large group, also in a single
    block; rows equal in id and text are worked on once and come back as often as they came."""
    rng = np.random.default_rng(5)
    own = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 120))
    line = own()
    rows = [(i, own() + line + own()) for i in range(300)]
    rows += [(7, rows[7][1])] * 3 + [(None, rows[0][1])] * 2 + [(500, line)] * 4
    may_repeat, block = passage_dedup.may_repeat, passage_dedup.Block

    def bounded(group, *rest):
        assert len(group) <= 20, len(group)
        return may_repeat(group, *rest)

    class Once(block):
        def __init__(self, ids, texts):
            assert len(set(zip(ids, texts))) == len(ids)
            super().__init__(ids, texts)

    monkeypatch.setattr(passage_dedup, "HOT", 20)
    monkeypatch.setattr(passage_dedup, "may_repeat", bounded)
    monkeypatch.setattr(passage_dedup, "Block", Once)
    for size in (4 << 20, 8000):
        monkeypatch.setattr(passage_dedup, "BLOCK_BYTES", size)
        got = passage_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        low = -(2**63)
        assert sorted(((low if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                      for r in got) == brute_passages(rows)


def test_passages_narrowed_windows(spark, monkeypatch):
    """Of windows that agree around their anchor only the common stretch goes into suffix arrays, once for all of them."""
    rng = np.random.default_rng(6)
    own = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 120))
    line = own()
    rows = [(i, f"{own()}{chr(32 + i)}{line}{chr(32 + i)}{own()}") for i in range(60)] + [(300, "a" * 70 + line[:60] + "\0" * 80), (301, line[30:90] + "\0" * 75)]
    classes = passage_dedup.classes

    def bounded(windows, ids, length):
        assert sum(map(len, windows)) <= 2000, sum(map(len, windows))
        return classes(windows, ids, length)

    monkeypatch.setattr(passage_dedup, "classes", bounded)
    for size in (4 << 20, 8000):
        monkeypatch.setattr(passage_dedup, "BLOCK_BYTES", size)
        got = passage_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_passages(rows)


def test_windows_are_told_apart():
    """Windows are grouped by their bytes, also where they end in zeros, and named whatever stands beside them."""
    rng = np.random.default_rng(7)
    raw = bytes(rng.choice([0, 0, 0, 1], 4000).astype(np.uint8))
    size = rng.integers(1, 30, 3000)
    lo = rng.integers(0, len(raw) - size + 1)
    keys = rng.integers(0, 3, len(lo)).astype(np.uint64)
    windows = passage_dedup.Windows(raw, lo, size)
    names = windows.names()
    texts = [raw[a : a + n] for a, n in zip(lo.tolist(), size.tolist())]
    assert windows.joined() == b"".join(texts)
    order, first = passage_dedup.copies(keys, windows, names)
    groups = [frozenset(x.tolist()) for x in np.split(order, first[1:])]
    want: dict = {}
    for i, one in enumerate(zip(keys.tolist(), texts)):
        want.setdefault(one, set()).add(i)
    assert set(groups) == set(map(frozenset, want.values())) and len(groups) == len(want)
    assert len(set(names.tolist())) == len(set(texts))
    for i in range(0, 3000, 97):
        assert passage_dedup.Windows(texts[i], np.array([0]), np.array([len(texts[i])])).names()[0] == names[i]


def test_passages_odd_rows(odd, nothing, spark):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    low = -(2**63)
    got = sorted(((low if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                 for r in passage_dedup.remove_repeats(odd).collect())
    assert got == brute_passages(rows)
    assert passage_dedup.remove_repeats(nothing).count() == 0


def test_fingerprints_are_unbiased(docs, odd, nothing, monkeypatch):
    monkeypatch.setattr(weighted_sampling, "RANGE_ROWS", 30)
    p = docs.toPandas().sort_values("doc_id")
    texts = [t or "" for t in p.text]
    after = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, after)]
    got = weighted_sampling.weighted_fingerprints(docs).toPandas().sort_values("doc_id")
    assert got.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    assert got.n_chars.tolist() == [len(t) for t in texts]

    def jaccard(a, b):
        a, b = (collections.Counter(WORD.findall(t)) for t in (a, b))
        both = set(a) | set(b)
        return sum(min(a[w], b[w]) for w in both) / sum(max(a[w], b[w]) for w in both) if both else 1.0

    off = np.array([jaccard(a, b) for a, b in zip(texts, edited)]) - got.near_edited.to_numpy()
    assert abs(off.mean()) < 0.02 and off.std() < 0.12
    same = got.assign(text=texts).groupby("text").fingerprint.nunique()
    assert (same == 1).all()


def test_fingerprints_odd_rows(odd, nothing):
    got = weighted_sampling.weighted_fingerprints(odd).collect()
    assert len(got) == 10
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {""}
    assert weighted_sampling.weighted_fingerprints(nothing).count() == 0
    one = weighted_sampling.weighted_fingerprints(odd.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
