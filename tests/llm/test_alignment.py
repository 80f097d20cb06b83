from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from clickstack.llm import alignment as A

HARD = ["", " ", "  ", "a", " lead", "trail ", "two  spaces", "tab\t here", "line\n next\n\n  more", "a▁b c", "x" * 3000, "don't I'll 's 've",
        "<|endoftext|> plain", "<s> </s> <unk> <0x41>", "café 東京 \U0001f642\U0001f642 naïve", "nul\x00 here", "\x1c x\x1f y", "　wide   em ᠎ mong",
        "1234567 3.14, (a) [b] {c} --- ... !?", "word " * 500, "end\n", "\n", "a  b   c    d" * 40, "é ﬁ ½ ​ zero", " nbsp   x"]


@pytest.fixture(scope="module")
def encoders():
    return A.Encoders()


def brute(texts, encoders):
    """Documents encoded whole, byte by byte."""
    rows, pairs_of, counts = [], [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = encoders.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = encoders.b.encode(t) if t else []
        whole = b"".join(encoders.a_bytes[i] for i in a) == raw == b"".join(encoders.b_bytes[i] for i in b)
        if not t or not whole:
            rows.append((0, 0, 0, 0, ""))
            pairs_of.append([])
            continue
        at = lambda ids, known: [i for i, x in enumerate(ids) for _ in known[x]]  # noqa: E731  token of each byte
        links = sorted(set(zip(at(a, encoders.a_bytes), at(b, encoders.b_bytes))))
        ends = lambda ids, known: set(np.cumsum([len(known[x]) for x in ids]).tolist())
        cuts = sorted(ends(a, encoders.a_bytes) & ends(b, encoders.b_bytes))
        groups, left = [], [(list(a), encoders.a_bytes, [0]), (list(b), encoders.b_bytes, [0])]
        for cut in cuts:
            side = []
            for ids, known, end in left:
                own = []
                while ids and end[0] + len(known[ids[0]]) <= cut:
                    end[0] += len(known[ids[0]])
                    own.append(str(ids.pop(0)))
                side.append(",".join(own))
            groups.append("|".join(side))
        rows.append((len(a), len(b), len(groups), len(links), sha256(";".join(groups).encode()).hexdigest()))
        pairs_of.append([(a[i], b[j]) for i, j in links])
        counts.update(set(pairs_of[-1]))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [(*r[:4], sum(counts[p] == top[p[0]] for p in own), sum(counts[p] for p in own), r[4]) for r, own in zip(rows, pairs_of)]


def as_rows(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_equal_to_brute_force(spark, docs, encoders):
    rows = [(r.doc_id, r.text) for r in docs.limit(200).collect()]
    rows = rows[:120] + [(10_000 + i, t) for i, t in enumerate(HARD)] + [(20_000, None)] + [(30_000 + i, rows[3][1]) for i in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = dict(zip([i for i, _ in rows], brute([t for _, t in rows], encoders)))
    assert as_rows(A.align_tokenizers(table)) == want
    # Many small blocks, merged in three levels.
    assert as_rows(A.align_tokenizers(table, block_chars=2000, fan_in=3, radix=4)) == want


def test_memory_that_starts_afresh(spark, docs, encoders, monkeypatch):
    texts = [t for t in HARD if t] + [r.text for r in docs.limit(20).collect() if r.text]
    table = A.Table(encoders)
    want, _ = A.block_rows(table, list(range(len(texts))), texts, 4)
    monkeypatch.setattr(A, "MEMORY", 50)
    small = A.Table(encoders)
    for i, t in enumerate(texts):
        got, _ = A.block_rows(small, [i], [t], 4)
        assert got == [want[i]]


def test_odd_rows(spark, odd, nothing):
    assert A.align_tokenizers(nothing).collect() == []
    got = A.align_tokenizers(odd).collect()
    assert len(got) == odd.count()
    twice = [tuple(r)[1:] for r in got if r.doc_id == 4]
    assert len(twice) == 2 and twice[0] == twice[1]
    empty = next(r for r in got if r.doc_id == 1)
    assert tuple(empty)[1:] == (0, 0, 0, 0, 0, 0, "")


def test_merging_counts_and_marks_ties():
    run = lambda pairs: (A.pack(np.diff(np.array([p for p, _ in pairs]), prepend=0), np.array([n for _, n in pairs])), len(pairs))
    a, b = 3 << 16, 4 << 16
    runs = [run([(a + 1, 2), (a + 5, 1), (b + 1, 7)]), run([(a + 5, 1), (b + 2, 6)]), run([(b + 2, 1)])]
    assert list(A.counted_pairs(runs)) == [(a + 1, 2), (a + 5, 2), (b + 1, 7), (b + 2, 7)]
    final, n = A.marked([A.merged(runs[:2]), runs[2], run([(b + 9, 1)])])
    steps, counts, best = next(A.unpack(final, n, 3))
    assert np.cumsum(steps).tolist() == [a + 1, a + 5, b + 1, b + 2, b + 9]
    assert counts.tolist() == [2, 2, 7, 7, 1] and best.tolist() == [1, 1, 1, 1, 0]
