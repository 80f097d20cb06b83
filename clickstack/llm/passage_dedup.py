"""Repeated passages by suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id is
removed. Strings are judged on the input.

Documents are dealt over blocks by a hash. Which strings can repeat is narrowed down by anchors: of the
``gram`` byte runs in every stretch of ``length`` bytes, the one whose hash is least is its anchor, so
equal stretches have equal anchors. The window of an anchor is all stretches it stands for. (1) Blocks report the hashes of their anchors; hashes found in
two blocks, or twice in one, come back. (2) Blocks send the windows around such anchors, each distinct one
once with its least id. Windows of one anchor meet in one group; those that differ too near the anchor from
all others to share a string are settled, and of the others the stretches in which they agree with another are
taken, each distinct one once. The suffix array of these laid end to end, built by linear grouping, brings equal
strings together, and the least id of each class goes back to the blocks. (3) Blocks remove what a smaller id has.

A string of ``length`` bytes lies whole in the window of its anchor, and its equals in windows of the same, so no
repeat is missed and none across documents arises. The text is shuffled once; the three passes share it.
Windows that are copies are folded per block before they are sent. Blocks also report how many distinct windows
an anchor has, and one byte of the hash of a single one, so that copies in many blocks count as one. An anchor
with more than about ``HOT`` distinct windows is not gathered: its windows are cut into their single strings of
``length`` bytes, and these meet by their own hash. So no group has more than that. Rows that are equal in id and
text are folded to one with a count, per batch before the shuffle and again in the block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstack.llm.base import ship_by_value, text_of
from clickstack.llm.suffix_array import suffix_array

LENGTH = 50
GRAM = 24
#: Bytes of text per block, anchors per bucket, distinct windows that one anchor may have before it counts as hot.
BLOCK_BYTES = 4 << 20
BUCKET_ANCHORS = 1 << 18
HOT = 256
#: Bytes that are put into one suffix array at a time, unless one group alone has more; few stay in the cache.
BATCH_BYTES = 1 << 14
LEAST_ID = -(2**63)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Base of the window hash and its inverse, modulo 2^64.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
#: Masks for the first 0 to 8 of eight bytes.
BYTES_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Block:
    """The documents of one block laid end to end."""

    def __init__(self, ids, texts):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.ids = np.asarray(ids, np.int64)
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.raw = b"".join(raw)

    def anchors(self, length: int, gram: int) -> "Anchors":
        found = [tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))]
        n, a = len(self.sizes), 0
        while a < n:  # so many documents that the arrays stay in the processor's cache
            b = int(np.searchsorted(self.ends, self.starts[a] + (1 << 17), "right"))
            b = min(n, max(b, a + 1))
            base = self.starts[a]
            at, hashes, lo, hi = anchor_grams(self.raw[int(base) : int(self.ends[b - 1])], length, gram)
            at, lo, hi = at + base, lo + base, hi + base
            doc = np.searchsorted(self.ends, at, "right")
            lo, hi = np.maximum(lo, self.starts[doc]), np.minimum(hi, self.ends[doc] - length)
            own = lo <= hi
            found.append((at[own], hashes[own], doc[own], lo[own], hi[own]))
            a = b
        return Anchors(*(np.concatenate(x) for x in zip(*found)))

    def window_hashes(self, found: "Anchors", length: int) -> np.ndarray:
        """A hash of all bytes of each anchor's window."""
        out = np.zeros(len(found.lo), np.uint64)
        flat = np.frombuffer(self.raw, np.uint8)
        powers = inverses = np.ones(1, np.uint64)
        for x in range(0, len(out), 1 << 13):
            lo, end = found.lo[x : x + (1 << 13)], found.hi[x : x + (1 << 13)] + length
            base = int(lo.min())
            part = flat[base : int(end.max())]
            if len(powers) <= len(part):
                powers, inverses = (np.r_[np.uint64(1), np.cumprod(np.full(2 * len(part), b, np.uint64))] for b in (BASE, INVERSE))
            sums = np.r_[np.uint64(0), np.cumsum((part + np.uint64(1)) * powers[: len(part)])]
            h = (sums[end - base] - sums[lo - base]) * inverses[lo - base]
            out[x : x + (1 << 13)] = (h ^ (h >> np.uint64(32))) * MIX
        return out


class Anchors:
    """Positions, hashes and document numbers of anchors; each is the anchor of the strings that start from
    ``lo`` up to ``hi``, and its window reaches from ``lo`` to the end of the last of them."""

    def __init__(self, at, hashes, doc, lo, hi):
        self.at, self.hashes, self.doc, self.lo, self.hi = at, hashes, doc, lo, hi

    def where(self, mask) -> "Anchors":
        return Anchors(self.at[mask], self.hashes[mask], self.doc[mask], self.lo[mask], self.hi[mask])


def anchor_grams(raw: bytes, length: int, gram: int):
    """Start and hash of the anchors of ``raw``, and the first and last start of the strings they stand for.

    The anchor of a string of ``length`` bytes is the first of its runs of ``gram`` bytes with the least hash
    of its first eight bytes."""
    n = len(raw) - gram + 1
    width = length - gram + 1
    if len(raw) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    least = (words[:n] ^ (words[:n] >> np.uint64(29))) * MIX & ~np.uint64((1 << 32) - 1) | np.arange(n, dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    chosen = least.astype(np.uint32)  # the position, in the lower half
    lo = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    hi = np.r_[lo[1:], len(chosen)] - 1
    at = chosen[lo].astype(np.int64)
    h = words[at] * MIX
    for k in range(8, gram, 8):
        h = (h ^ (h >> np.uint64(31)) ^ words[at + min(k, gram - 8)]) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return at, h ^ (h >> np.uint64(29)), lo, hi


class Keys:
    """Anchor hashes cut to 40 bits below the bits of the bucket."""

    def __init__(self, bucket_bits: int):
        self.shift = np.uint64(24 - bucket_bits)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> self.shift

    @staticmethod
    def pack(keys: np.ndarray) -> bytes:
        return np.ascontiguousarray(keys.astype("<u8")[:, None].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()

    @staticmethod
    def unpack(raw: bytes, bucket: int) -> np.ndarray:
        out = np.zeros((len(raw) // 5, 8), np.uint8)
        out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        return out.view("<u8").ravel() | np.uint64(bucket << 40)


def by_bucket(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys."""
    buckets = (keys >> np.uint64(40)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(keys) else []
    return [(int(buckets[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(keys)])]


class Windows:
    """Stretches of ``raw``, from ``lo`` on and ``size`` bytes long, read eight bytes at a time."""

    def __init__(self, raw: bytes, lo: np.ndarray, size: np.ndarray):
        self.raw, self.lo, self.size = raw, lo, size
        self.columns = -(-int(size.max()) // 8) if len(size) else 0
        padded = raw + bytes(8)
        self.words = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))

    def where(self, at) -> "Windows":
        out = Windows.__new__(Windows)
        out.raw, out.words, out.columns, out.lo, out.size = self.raw, self.words, self.columns, self.lo[at], self.size[at]
        return out

    def column(self, k: int) -> np.ndarray:
        """The ``k``-th eight bytes of each window, zeros behind its end."""
        left = np.clip(self.size - 8 * k, 0, 8)
        return self.words[np.minimum(self.lo + 8 * k, len(self.raw))] & BYTES_LEFT[left]

    def names(self) -> np.ndarray:
        """A hash of 64 bits of each window, whatever windows stand beside it: zeros add nothing."""
        h = self.size.astype(np.uint64) * MIX
        for k in range(self.columns):
            c = self.column(k)
            c = (c ^ (c >> np.uint64(32))) * np.uint64(pow(BASE, k + 1, 1 << 64))
            h += (c ^ (c >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))

    def change(self) -> np.ndarray:
        """Whether a window differs from the one before it; the first does."""
        out = np.ones(len(self.lo), bool)
        out[1:] = self.size[1:] != self.size[:-1]
        for k in range(self.columns):
            c = self.column(k)
            out[1:] |= c[1:] != c[:-1]
        return out

    def joined(self) -> bytes:
        parts = []
        for x in range(0, len(self.lo), 1 << 14):
            part = self.where(slice(x, x + (1 << 14)))
            laid = np.stack([part.column(k) for k in range(self.columns)], axis=1).view(np.uint8)
            parts.append(laid[np.arange(8 * self.columns) < part.size[:, None]].tobytes())
        return b"".join(parts)


def copies(keys: np.ndarray, windows: Windows, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows by key in which those equal in key and bytes are neighbours, and where others begin."""
    order = np.lexsort((names, keys))
    new = windows.where(order).change()
    new[1:] |= keys[order][1:] != keys[order][:-1]
    return order, np.flatnonzero(new)


def spread(number: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items that each belong to the group ``number`` of ``counts`` rows that lie group by group: every pair
    (item, row)."""
    each = counts[number]
    item = np.repeat(np.arange(len(number)), each)
    first = (np.cumsum(counts) - counts)[number]
    return item, np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)


def windows_of(block: Block, found: Anchors, length: int, hot: np.ndarray, keys_of: Keys):
    """Keys, windows, their hashes, documents and anchors' places of anchors; hot ones as their single strings."""
    keys = keys_of.of(found.hashes)
    cold = ~np.isin(keys, hot) if len(hot) else np.ones(len(keys), bool)
    c, h = found.where(cold), found.where(~cold)
    each = h.hi - h.lo + 1
    item = np.repeat(np.arange(len(each)), each)
    lo = h.lo[item] + np.arange(len(item)) - (np.cumsum(each) - each)[item]
    windows = Windows(block.raw, np.r_[c.lo, lo], np.r_[c.hi + length - c.lo, np.full(len(lo), length, np.int64)])
    names = windows.names()
    keys = np.r_[keys[cold], keys_of.of(names[len(c.lo) :])]
    return keys, windows, names, np.r_[c.doc, h.doc[item]], np.r_[c.at, h.at[item]] - windows.lo


def shared_start(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def may_repeat(group: list[tuple[int, bytes]], length: int, gram: int) -> list[tuple[int, int] | None]:
    """The stretch of each window (anchor's place, bytes) of one anchor in which it can have strings in common with
    another: as far as it agrees with some other one before and behind the anchor. None if that holds no string."""
    before, behind = [0] * len(group), [0] * len(group)
    ways = ((before, [w[:at][::-1] for at, w in group]), (behind, [w[at + gram :] for at, w in group]))
    for far, texts in ways:
        order = sorted(range(len(group)), key=texts.__getitem__)
        for i, j in zip(order, order[1:]):
            n = shared_start(texts[i], texts[j])
            far[i], far[j] = max(far[i], n), max(far[j], n)
    spans = [(at - min(at, b), min(len(w), at + gram + r)) for (at, w), b, r in zip(group, before, behind)]
    return [(x, y) if y - x >= length else None for x, y in spans]


def classes(windows: list[bytes], ids: list[int], length: int):
    """For the windows of one batch: (window number, offset, least id) of every string of ``length`` bytes, from
    the suffix array of the windows laid end to end with a lower mark behind each."""
    text: list[int] = []
    starts = []
    for w in windows:
        starts.append(len(text))
        text.extend([x + 2 for x in w])
        text.append(1)
    text[-1] = 0
    order = np.array(suffix_array(text), np.int64)
    owner = np.repeat(np.arange(len(windows)), [len(w) + 1 for w in windows])
    ends = np.array([s + len(w) for s, w in zip(starts, windows)], np.int64)
    order = order[order + length <= ends[owner[order]]]
    flat = np.array(text, np.uint16)
    rows = np.lib.stride_tricks.sliding_window_view(flat, length)[order] if len(order) else np.zeros((0, length))
    new = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)] if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    who = owner[order]
    least = np.minimum.reduceat(np.array(ids, np.int64)[who], at) if len(at) else np.zeros(0, np.int64)
    return who, order - np.array(starts, np.int64)[who], least[np.cumsum(new) - 1] if len(at) else least


def fold(batches):
    """Equal rows of a batch as one with their number."""
    for batch in batches:
        names = ["doc_id", "no_id", "text"]
        one = pa.Table.from_batches([batch]).group_by(names).aggregate([([], "count_all")])
        yield from one.select([*names, "count_all"]).rename_columns([*names, "n"]).to_batches()


def folded(rows: pd.DataFrame) -> pd.DataFrame:
    """Equal rows of a block as one with their number."""
    if not rows.duplicated(["doc_id", "no_id"]).any():
        return rows
    return rows.groupby(["doc_id", "no_id", "text"], sort=False, as_index=False).agg(n=("n", "sum"), block=("block", "first"))


def distinct_at_most(where: np.ndarray, n_keys: int, distinct: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Per key how many distinct windows its blocks hold together: those of the blocks summed, but blocks with a
    single window that have the key's commonest mark hold the same one."""
    n = np.bincount(where, distinct, n_keys).astype(np.int64)
    large = np.flatnonzero(n > HOT)
    if len(large):
        number = np.full(n_keys, -1)
        number[large] = np.arange(len(large))
        own = (number[where] >= 0) & (distinct == 1)
        same = np.bincount(number[where[own]] * 256 + marks[own], minlength=256 * len(large)).reshape(-1, 256).max(axis=1)
        n[large] -= np.maximum(same - 1, 0)
    return n


def all_keys(rows: pd.DataFrame, column: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(Keys.unpack(k, b) for k, b in zip(rows[column], rows["bucket"]))])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, with_kept: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    ``kept`` holds the remaining bytes (null unless ``with_kept``), ``n_spans`` counts the maximal removed runs. A null id is smaller than
    any other; rows with equal ids take nothing from one another. Null texts count as empty. Texts under
    ``length`` bytes stay whole. An empty table gives an empty result. Only id and text are read."""
    if not 8 <= gram <= length:
        raise ValueError("gram must be at least 8 and at most length")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID).cast("long")).alias("doc_id"),
                       F.col(id_col).isNull().alias("no_id"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    bits = min(24, max(0, (2 * total // (length - gram + 2) // BUCKET_ANCHORS).bit_length()))
    keys_of = Keys(bits)
    size_kind = "<u1" if 2 * length - gram < 256 else "<u2"
    rows = rows.mapInArrow(fold, "doc_id long, no_id boolean, text string, n long")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = folded(pdf)
        block = Block(pdf["doc_id"], pdf["text"])
        found = block.anchors(length, gram)
        keys, doc = keys_of.of(found.hashes), found.doc
        order = np.lexsort((doc, keys))
        hashes = block.window_hashes(found, length)[order]
        keys, doc = keys[order], doc[order]
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        last = np.r_[at[1:], len(keys)] - 1 if len(at) else at
        twice = doc[at] != doc[last]
        found, marks = keys[at], (hashes[at] >> np.uint64(56)).astype(np.uint8)
        # Distinct windows of the anchors that the block holds more than once.
        distinct = np.ones(len(at), np.int64)
        group = np.cumsum(new) - 1
        many = (last > at)[group] if len(at) else new
        group, hashes = group[many], hashes[many]
        by_hash = np.lexsort((hashes, group))
        group, hashes = group[by_hash], hashes[by_hash]
        other = (group[1:] == group[:-1]) & (hashes[1:] != hashes[:-1])
        distinct += np.bincount(group[1:][other], minlength=len(at))
        block = int(pdf["block"].iloc[0])
        out = []
        for b, x, y in by_bucket(found):
            more = np.flatnonzero(distinct[x:y] > 1)
            out.append((b, block, Keys.pack(found[x:y]), np.packbits(twice[x:y]).tobytes(), marks[x:y].tobytes(),
                        np.stack([more, distinct[x:y][more]]).astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["bucket", "block", "keys", "twice", "marks", "more"])

    def repeated(key, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(key[0])
        own = [Keys.unpack(k, bucket) for k in pdf["keys"]]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)).astype(bool) for t, k in zip(pdf["twice"], own)]
        keys, again = np.concatenate(own), np.concatenate(twice)
        found, where, n = np.unique(keys, return_inverse=True, return_counts=True)
        many = (n > 1) | (np.bincount(where, again, len(found)) > 0)
        distinct, ends = np.ones(len(keys), np.int64), np.cumsum([len(k) for k in own])
        for start, more in zip(ends - [len(k) for k in own], pdf["more"]):
            place, count = np.frombuffer(more, "<u4").astype(np.int64).reshape(2, -1)
            distinct[start + place] = count
        marks = np.frombuffer(b"".join(pdf["marks"]), np.uint8)
        hot = many & (distinct_at_most(where, len(found), distinct, marks) > HOT)
        mine, hot = np.split(many[where], ends[:-1]), np.split(hot[where], ends[:-1])
        out = [(int(b), bucket, Keys.pack(k[m]), Keys.pack(k[h])) for b, k, m, h in zip(pdf["block"], own, mine, hot) if m.any()]
        return pd.DataFrame(out, columns=["block", "bucket", "keys", "hot"])

    def windows_at(block: Block, keys: np.ndarray, hot: np.ndarray):
        """Windows of the block's anchors that are among ``keys``."""
        found = block.anchors(length, gram)
        own, keys = keys_of.of(found.hashes), np.unique(keys)
        place = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        return windows_of(block, found.where(keys[place] == own if len(keys) else np.zeros(len(own), bool)), length, hot, keys_of)

    def send(left: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "block", "keys", "sizes", "ids", "twice", "windows", "hot"]
        if not len(left) or not len(known):
            return pd.DataFrame([], columns=columns)
        left = folded(left)
        block = Block(left["doc_id"], left["text"])
        seen: dict[tuple[int, bytes, int], list] = {}
        keys, windows, names, doc, place = windows_at(block, all_keys(known, "keys"), all_keys(known, "hot"))
        out, pack = [], zstandard.ZstdCompressor(level=3)
        if len(keys):
            order, first = copies(keys, windows, names)
            ids = block.ids[doc[order]]
            least, most = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
            one = order[first]
            keys, windows, place = keys[one], windows.where(one), place[one]
            sizes = np.stack([windows.size, place], axis=1).astype(size_kind)
        for bucket, x, y in by_bucket(keys):
            out.append((bucket, int(left["block"].iloc[0]), Keys.pack(keys[x:y]), sizes[x:y].tobytes(),
                        pack.compress(least[x:y].astype("<i8").tobytes()), np.packbits(least[x:y] != most[x:y]).tobytes(),
                        pack.compress(windows.where(slice(x, y)).joined()), b""))
        # Hot anchors come back with the answers: the last pass has to cut the same strings.
        for bucket, hot in zip(known["bucket"], known["hot"]):
            if len(hot):
                out.append((int(bucket), int(left["block"].iloc[0]), b"", b"", b"", b"", b"", hot))
        return pd.DataFrame(out, columns=columns)

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(key[0])
        columns = ["block", "bucket", "keys", "hashes", "at", "n", "least", "hot"]
        # Per block: its keys, window sizes and anchors' places, ids, whether two documents hold a window, windows.
        out, senders, unpack = [], [], zstandard.ZstdDecompressor()
        for row in pdf.itertuples():
            if row.hot:
                out.append((int(row.block), bucket, b"", b"", b"", b"", b"", row.hot))
                continue
            own = Keys.unpack(row.keys, bucket)
            senders.append((np.full(len(own), row.block), own, np.frombuffer(row.sizes, size_kind).astype(np.int64).reshape(-1, 2),
                            np.frombuffer(unpack.decompress(row.ids), "<i8"),
                            np.unpackbits(np.frombuffer(row.twice, np.uint8), count=len(own)).astype(bool), unpack.decompress(row.windows)))
        if not senders:
            return pd.DataFrame(out, columns=columns)
        *arrays, parts = zip(*senders)
        sender, keys, sizes, ids, twice = (np.concatenate(x) for x in arrays)
        raw, (size, place) = b"".join(parts), sizes.T
        windows = Windows(raw, np.cumsum(size) - size, size)
        names = windows.names()
        order, first = copies(keys, windows, names)
        # From here on windows are distinct; number: that of each one sent.
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
        least = np.minimum.reduceat(ids[order], first)
        one = order[first]
        lows, ends, places = windows.lo[one], windows.lo[one] + size[one], place[one]
        starts = np.flatnonzero(np.r_[True, keys[one][1:] != keys[one][:-1]])
        group_ends = np.r_[starts[1:], len(one)]
        # (window, first offset, number of strings, least id) as arrays; strings outside of the stretches that may
        # repeat stand nowhere else but in copies of the window.
        runs, own = [], []
        alone = np.ones(len(one), bool)

        def settle(batch):
            texts, members = [t for t, _ in batch], [m for _, m in batch]
            who, offset, low = classes(texts, [int(least[[w for w, _ in m]].min()) for m in members], length)
            # Runs of neighbouring offsets of a text with one least id, for every window that has the text.
            by = np.lexsort((offset, who))
            who, offset, low = who[by], offset[by], low[by]
            cut = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (low[1:] != low[:-1])])
            n = np.diff(np.r_[cut, len(who)])
            run, member = spread(who[cut], np.array([len(m) for m in members]))
            window, ahead = np.array([m for ms in members for m in ms], np.int64)[member].T
            runs.append((window, offset[cut][run] + ahead, n[run], low[cut][run]))

        batch, held = [], 0
        many = group_ends - starts > 1
        for a, b in zip(starts[many].tolist(), group_ends[many].tolist()):
            texts = [raw[x:y] for x, y in zip(lows[a:b].tolist(), ends[a:b].tolist())]
            part: dict[bytes, list[tuple[int, int]]] = {}
            for w, (t, span) in enumerate(zip(texts, may_repeat(list(zip(places[a:b].tolist(), texts)), length, gram)), a):
                if span:
                    x, y = span
                    part.setdefault(t[x:y], []).append((w, x))
                    alone[w] = False
                    own += [(w, 0, x)] if x else []
                    own += [(w, y - length + 1, len(t) - y)] if y < len(t) else []
            size_of = sum(map(len, part))
            if held and held + size_of > BATCH_BYTES:
                settle(batch)
                batch, held = [], 0
            batch.extend(part.items())
            held += size_of
        if batch:
            settle(batch)
        alone = np.flatnonzero(alone)
        runs.append((alone, np.zeros(len(alone), np.int64), ends[alone] - lows[alone] - length + 1, least[alone]))
        w, at, n = np.array(own, np.int64).reshape(-1, 3).T
        runs.append((w, at, n, least[w]))
        window, at, n, low = (np.concatenate(x) for x in zip(*runs))
        by = np.lexsort((at, window))
        window, at, n, low = window[by], at[by], n[by], low[by]
        cut = np.flatnonzero(np.r_[True, (window[1:] != window[:-1]) | (low[1:] != low[:-1])])
        window, at, n, low = window[cut], at[cut], np.add.reduceat(n, cut), low[cut]
        sent, run = spread(number, np.bincount(window, minlength=len(one)))
        told = (low[run] < ids[sent]) | twice[sent]
        sent, run = sent[told], run[told]
        cuts = np.flatnonzero(np.r_[True, sender[sent][1:] != sender[sent][:-1]]) if len(sent) else []
        for a, b in zip(cuts, [*cuts[1:], len(sent)]):
            e, r = sent[a:b], run[a:b]
            out.append((int(sender[e[0]]), bucket, Keys.pack(keys[e]), names[e].astype("<u8").tobytes(), at[r].astype("<u2").tobytes(),
                        n[r].astype("<u2").tobytes(), low[r].astype("<i8").tobytes(), b""))
        return pd.DataFrame(out, columns=columns)

    def take_out(left: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "no_id", "n", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        if not len(left):
            return pd.DataFrame([], columns=columns)
        left = folded(left)
        block = Block(left["doc_id"], left["text"])
        raw, gone = block.raw, np.zeros(len(block.raw), bool)
        if len(told):
            hot = all_keys(told, "hot")
            known_keys = all_keys(told, "keys")
            names, at, n, least = (np.frombuffer(b"".join(told[c]), t) for c, t in (("hashes", "<u8"), ("at", "<u2"), ("n", "<u2"), ("least", "<i8")))
            keys, windows, own, doc, _ = windows_at(block, np.r_[known_keys, hot], hot)
            # Equal (key, hash) pairs get one number; answers lie by number.
            both, hashes = np.r_[known_keys, keys], np.r_[names, own]
            order = np.lexsort((hashes, both))
            both, hashes = both[order], hashes[order]
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(np.r_[False, (both[1:] != both[:-1]) | (hashes[1:] != hashes[:-1])]) if len(order) else 0
            by = np.argsort(number[: len(names)], kind="stable")
            window, run = spread(number[len(names) :], np.bincount(number[: len(names)], minlength=len(order)))
            run = by[run]
            take = least[run] < block.ids[doc[window]]
            window, run = window[take], run[take]
            start = windows.lo[window] + at[run]
            change = np.bincount(start, minlength=len(raw) + 1) - np.bincount(start + n[run] - 1 + length, minlength=len(raw) + 1)
            gone = np.cumsum(change[:-1]) > 0
        flat = np.frombuffer(raw, np.uint8)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = block.starts[block.sizes > 0]
        begins[heads] = gone[heads]
        removed, spans = (np.diff(np.r_[0, np.cumsum(x)][np.r_[block.starts, len(raw)]]).tolist() for x in (gone, begins))
        out = []
        for no_id, n, doc_id, a, b, r, s in zip(left["no_id"], left["n"], block.ids.tolist(), block.starts.tolist(), block.ends.tolist(), removed, spans):
            kept = flat[a:b][~gone[a:b]].tobytes() if r else raw[a:b]
            out.append((doc_id, no_id, n, b - a, r, s, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        return pd.DataFrame(out, columns=columns)

    by_block = rows.groupBy("block")
    reports = by_block.applyInPandas(report, "bucket long, block long, keys binary, twice binary, marks binary, more binary")
    known = reports.groupBy("bucket").applyInPandas(repeated, "block long, bucket long, keys binary, hot binary")
    sent = by_block.cogroup(known.groupBy("block")).applyInPandas(
        send, "bucket long, block long, keys binary, sizes binary, ids binary, twice binary, windows binary, hot binary")
    told = sent.groupBy("bucket").applyInPandas(
        compare, "block long, bucket long, keys binary, hashes binary, at binary, n binary, least binary, hot binary")
    out = by_block.cogroup(told.groupBy("block")).applyInPandas(
        take_out, "doc_id long, no_id boolean, n long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


ship_by_value(__name__)
