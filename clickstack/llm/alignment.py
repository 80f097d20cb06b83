"""Alignment of the tokens of two tokenizers, with corpus-wide pair counts by external spill counting.

A task encodes its documents, finds the byte places where tokens of both sides end, and gathers
pair-document records: which A and B tokens overlap in which document. Records are radix-partitioned by
the low bits of the A id into sorted runs, compressed with zstd and written to the shared folder, a block of
documents at a time. Runs of a bounded number of blocks are merged by a k-way heap merge that counts each
pair's documents; merged runs are merged again, level by level, until one run per radix is left. The runs are
side-major (by A id, then B id), so the last merge sees all pairs of an A id together and marks the ones with
its highest count. The final runs then stream back to the records: each block adds up, per document, what its
links contribute.

No task sees more than a block of documents, a fan-in of runs, or the distinct pairs of one radix, whose number the
two vocabularies bound. How often a pair is found in the corpus changes no task's size, only its numbers.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstack.llm.base import process_cache, ship_by_value, stash, text_of

#: Tokenizer files, looked up where they are used: A is byte-level, B is a piece model that adds the first space.
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Parts of the A ids, by their low bits; a power of two.
RADIX = 16
#: Code points and documents of a block of records, runs that one merge takes.
BLOCK_CHARS, BLOCK_DOCS = 8_000_000, 1 << 14
FAN_IN = 64
#: Segments, and code points of them together, that a worker remembers before it starts afresh.
MEMORY, MEMORY_CHARS = 300_000, 24_000_000
#: Pairs decompressed at a time by a merge.
CHUNK = 1 << 13
B_BITS = 16

#: White space after which a space opens no segment; wider than what either tokenizer takes for it.
OPEN = re.compile(r"[\s\u180e]\Z")
CUT = re.compile(r"(?<=[^\s\u180e]) ")


def segments(text: str) -> list[str]:
    """The text cut at each space that follows a character other than white space, without these spaces. Both
    tokenizers cut there, so tokens and links of a segment do not depend on what is around it."""
    head, *rest = CUT.split(" " + text)
    return [head[1:], *rest]


class Encoders:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_level: str = BYTE_LEVEL, pieces: str = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(byte_level))
        self.a.encode_special_tokens = True  # their strings inside a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        # Byte-level entries write each byte as a printable character: itself, or one from U+0100 on, in order.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = sorted(set(range(256)) - set(plain))
        byte_of = {chr(x): x for x in plain} | {chr(0x100 + k): x for k, x in enumerate(hidden)}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 2)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry if c in byte_of)
        self.b_bytes = [bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size()) for piece in (self.b.id_to_piece(i),)]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and the text by A, and of the text by B; None where the bytes of either differ from them."""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text) if text else [self.b.piece_to_id("▁")]  # alone, the model adds no space to nothing
        raw = (" " + text).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A place, B place) of all pairs of tokens whose byte ranges overlap, in order."""
    a_starts, b_starts = np.r_[0, a_ends[:-1]], np.r_[0, b_ends[:-1]]
    low = np.searchsorted(b_ends, a_starts, "right")
    n = np.searchsorted(b_starts, a_ends, "left") - low
    first = np.repeat(np.arange(len(a_ends)), n)
    return first, np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Table:
    """What is known of each segment: counts, text of its groups, codes of its links."""

    def __init__(self, encoders: Encoders):
        self.encoders, self.known = encoders, {}
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.chars, self.used = 0, 0
        self.counts = np.zeros((4, 1024), np.int64)  # A tokens, B tokens, groups, links
        self.bad, self.open = np.zeros(1024, bool), np.zeros(1024, bool)
        self.starts = np.zeros(1025, np.int64)
        self.codes = np.zeros(4096, np.int64)
        self.groups: list[str] = []

    def _room(self, more: int, links: int) -> None:
        def wider(x: np.ndarray, n: int) -> np.ndarray:
            if n <= x.shape[-1]:
                return x
            out = np.zeros((*x.shape[:-1], max(n, 2 * x.shape[-1])), x.dtype)
            out[..., : x.shape[-1]] = x
            return out

        n = self.used + more
        self.counts, self.bad, self.open = wider(self.counts, n), wider(self.bad, n), wider(self.open, n)
        self.starts = wider(self.starts, n + 1)
        self.codes = wider(self.codes, int(self.starts[self.used]) + links)

    def _add(self, words: list[str], counts: np.ndarray, codes: np.ndarray, sizes: np.ndarray, groups: list[str],
             bad: bool = False, is_open: bool = False) -> None:
        n, at = len(words), self.used
        self._room(n, len(codes))
        start = int(self.starts[at])
        self.counts[:, at : at + n] = counts
        self.bad[at : at + n], self.open[at : at + n] = bad, is_open
        self.codes[start : start + len(codes)] = codes
        self.starts[at + 1 : at + n + 1] = start + np.cumsum(sizes)
        self.groups.extend(groups)
        self.known.update(zip(words, range(at, at + n)))
        self.chars += sum(map(len, words))
        self.used += n

    def _enter(self, words: list[str], ids: tuple[np.ndarray, np.ndarray], is_open: bool = False) -> bool:
        """Enter the words that were encoded together, each with a space before; False if a token crosses two."""
        a, b = ids
        a_ends, b_ends = np.cumsum(self.encoders.a_sizes[a]), np.cumsum(self.encoders.b_sizes[b])
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        last = np.searchsorted(cuts, ends)
        if not np.array_equal(cuts[np.minimum(last, len(cuts) - 1)], ends):
            return False
        x, y = overlaps(a_ends, b_ends)
        a_cut, b_cut = np.searchsorted(a_ends, cuts, "right"), np.searchsorted(b_ends, cuts, "right")
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        pieces, p, q = [], 0, 0
        for u, v in zip(a_cut.tolist(), b_cut.tolist()):
            pieces.append(f"{','.join(a_text[p:u])}|{','.join(b_text[q:v])}")
            p, q = u, v
        stops = (last + 1).tolist()
        texts, p = [], 0
        for u in stops:
            texts.append(";".join(pieces[p:u]))
            p = u
        links = np.bincount(np.searchsorted(ends, a_ends[x], "left"), minlength=len(words))
        counts = np.diff(np.stack([a_cut[last], b_cut[last], last + 1]), axis=1, prepend=0)
        self._add(words, np.vstack([counts, links]), (a[x] << B_BITS) | b[y], links, texts, is_open=is_open)
        return True

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        if self.used and (self.used + len(fresh) > MEMORY or self.chars > MEMORY_CHARS):
            self.clear()
            fresh = list(words)
        apart = [w for w in fresh if not w or OPEN.search(w) or "▁" in w]
        held = set(apart)
        together = [w for w in fresh if w not in held]
        for at in range(0, len(together), 2048):
            part = together[at : at + 2048]
            ids = self.encoders.encode(" ".join(part))
            if ids is None or not self._enter(part, ids):
                apart.extend(part)
        for w in apart:
            ids = self.encoders.encode(w)
            is_open = not w or OPEN.search(w) is not None
            if ids is None or not self._enter([w], ids, is_open):
                self._add([w], np.zeros((4, 1)), np.zeros(0, np.int64), np.zeros(1, np.int64), [""], bad=True, is_open=is_open)

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Segment numbers of the texts end to end, and how many each text has."""
        parts = [t.split(" ") for t in texts]
        self.learn(set(chain.from_iterable(parts)))
        look = lambda own: np.fromiter(map(self.known.__getitem__, chain.from_iterable(own)), np.int64)
        kinds, sizes = look(parts), np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        is_open = self.open[kinds]
        is_open[ends - 1] = False  # white space at the end of a text opens nothing
        if is_open.any():
            torn = np.flatnonzero(np.add.reduceat(is_open, ends - sizes))
            for i in torn.tolist():
                parts[i] = segments(texts[i])
            self.learn(set(chain.from_iterable(parts)))
            kinds, sizes = look(parts), np.array([len(p) for p in parts], np.int64)
        return kinds, sizes


def pack(*columns: np.ndarray) -> bytes:
    """Whole 64-bit numbers, column by column within each chunk of rows, so that a reader needs one chunk at a time."""
    out = zstandard.ZstdCompressor(level=1).compressobj()
    parts = []
    for at in range(0, len(columns[0]), CHUNK):
        for c in columns:
            parts.append(out.compress(np.ascontiguousarray(c[at : at + CHUNK], "<i8").tobytes()))
    return b"".join([*parts, out.flush()])


def unpack(run: bytes, n: int, columns: int) -> Iterator[list[np.ndarray]]:
    """The chunks of a packed run of ``n`` rows."""
    reader = zstandard.ZstdDecompressor().stream_reader(run, read_across_frames=True)
    for at in range(0, n, CHUNK):
        rows = min(CHUNK, n - at)
        block = np.frombuffer(reader.read(8 * rows * columns), "<i8").reshape(columns, rows)
        yield list(block)


def counted_pairs(runs: Iterable[tuple[bytes, int]]) -> Iterator[tuple[int, int]]:
    """(pair, documents) of sorted runs of (step to the pair, documents): a heap merge that sums equal pairs."""

    def stream(run: bytes, n: int) -> Iterator[tuple[int, int]]:
        last = 0
        for steps, docs in unpack(run, n, 2):
            codes = last + np.cumsum(steps)
            last = int(codes[-1])
            yield from zip(codes.tolist(), docs.tolist())

    pair, total = -1, 0
    for code, docs in heapq.merge(*(stream(run, n) for run, n in runs)):
        if code == pair:
            total += docs
            continue
        if pair >= 0:
            yield pair, total
        pair, total = code, docs
    if pair >= 0:
        yield pair, total


def merged(runs: Iterable[tuple[bytes, int]]) -> tuple[bytes, int]:
    """One run out of several."""
    pairs = np.array(list(counted_pairs(runs)), np.int64).reshape(-1, 2)
    return pack(np.diff(pairs[:, 0], prepend=0), pairs[:, 1]), len(pairs)


def marked(runs: Iterable[tuple[bytes, int]]) -> tuple[bytes, int]:
    """One run out of several, with a mark on the pairs that have their A id's highest count. Pairs of an A id follow each
    other, so only one A id is held."""
    codes, counts, best, held = [], [], [], []

    def settle() -> None:
        top = max(n for _, n in held)
        for code, n in held:
            codes.append(code)
            counts.append(n)
            best.append(int(n == top))
        held.clear()

    for code, n in counted_pairs(runs):
        if held and held[0][0] >> B_BITS != code >> B_BITS:
            settle()
        held.append((code, n))
    if held:
        settle()
    return pack(np.diff(np.array(codes, np.int64), prepend=0), np.array(counts, np.int64), np.array(best, np.int64)), len(codes)


def block_rows(table: Table, ids: list, texts: list[str], radix: int) -> tuple[list, list]:
    """The documents of a block with their counts, and its runs of records."""
    found = {"n": np.zeros((4, len(texts)), np.int64), "sha": [""] * len(texts)}
    filled = [i for i, t in enumerate(texts) if t]
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if filled:
        kinds, sizes = table.numbered([texts[i] for i in filled])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        sound = np.add.reduceat(table.bad[kinds], starts) == 0
        at = np.array(filled)
        found["n"][:, at] = np.add.reduceat(table.counts[:, kinds], starts, axis=1) * sound
        groups = table.groups
        for i, s, e, ok in zip(filled, starts.tolist(), ends.tolist(), sound.tolist()):
            if ok:
                found["sha"][i] = sha256(";".join([groups[k] for k in kinds[s:e].tolist()]).encode()).hexdigest()
        owner = np.repeat(at, sizes)
        kept = np.repeat(sound, sizes)
        # Each segment of a document once, then its links: pair codes have 32 bits, documents of a block 16.
        own, often = np.unique(owner[kept] * table.used + kinds[kept], return_counts=True)
        doc, kind = np.divmod(own, max(1, table.used))
        n = table.starts[kind + 1] - table.starts[kind]
        place = np.repeat(table.starts[kind] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        code = table.codes[place]
        key = (((code >> B_BITS) & (radix - 1)) << 48) | (code << 16) | np.repeat(doc, n)
        order = np.argsort(key)
        key, often = key[order], np.repeat(often, n)[order]
        if len(key):
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            keys, times = key[first], np.add.reduceat(often, first)
    docs = [{"doc_id": d, "n_a": a, "n_b": b, "n_groups": g, "n_links": k, "groups_sha256": s}
            for d, a, b, g, k, s in zip(ids, *found["n"].tolist(), found["sha"])]
    runs = []
    edges = np.searchsorted(keys >> 48, np.arange(radix + 1))
    for part, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if s == e:
            continue
        code, doc = (keys[s:e] >> 16) & 0xFFFFFFFF, keys[s:e] & 0xFFFF
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        per_pair = np.diff(np.r_[first, len(code)])
        runs.append({"radix": part, "pairs": pack(np.diff(code[first], prepend=0), per_pair), "n_pairs": len(first),
                     "records": pack(doc, times[s:e]), "n_records": e - s})
    return docs, runs


DOCS = "docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string>>"
RUNS = "runs array<struct<radix: int, pairs: binary, n_pairs: bigint, records: binary, n_records: bigint>>"
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                            ("n_links", pa.int64()), ("groups_sha256", pa.string())]))
_RUNS = pa.list_(pa.struct([("radix", pa.int32()), ("pairs", pa.binary()), ("n_pairs", pa.int64()), ("records", pa.binary()),
                            ("n_records", pa.int64())]))


def blocks_of(docs: DataFrame, id_col: str, text_col: str, radix: int, block_chars: int, byte_level: str, pieces: str) -> DataFrame:
    """``block, docs, runs``: one row per block of documents."""

    def run(batches):
        cache = process_cache(f"aligned:{byte_level}:{pieces}")
        if "table" not in cache:
            cache["table"] = Table(Encoders(byte_level, pieces))
        task, made = TaskContext.get().partitionId(), 0
        ids, texts, chars = [], [], 0

        def block():
            docs_, runs = block_rows(cache["table"], ids, texts, radix)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made]), pa.array([docs_], _DOCS), pa.array([runs], _RUNS)],
                                              names=["block", "docs", "runs"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars >= block_chars or len(texts) >= BLOCK_DOCS:
                    yield block()
                    made += 1
                    ids, texts, chars = [], [], 0
        if texts:
            yield block()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(run, f"block bigint, {DOCS}, {RUNS}")


def _merge(runs: DataFrame, keys: list[str], how) -> DataFrame:
    """The runs (``pairs, n_pairs``) of equal ``keys`` made one by ``how``."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        pairs, n = how(zip(group["pairs"], group["n_pairs"]))
        return pd.DataFrame([(*key, pairs, n)], columns=[*keys, "pairs", "n_pairs"])

    kinds = dict(runs.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "pairs binary, n_pairs bigint"])
    return runs.groupBy(*keys).applyInPandas(run, schema)


def _contributions(blocks: DataFrame, final: DataFrame, groups: int) -> DataFrame:
    """``block, sums, bests``: per block the contributions of its links, by document."""
    runs = blocks.select("block", "group", F.size("docs").alias("n_docs"), F.inline("runs"))
    told = final.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(key, own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(met):
            steps, counts, best = (np.concatenate(c) for c in zip(*unpack(met["pairs"].iloc[0], met["n_pairs"].iloc[0], 3)))
            codes = np.cumsum(steps)
            for r in own.itertuples():
                step, per_pair = (np.concatenate(c) for c in zip(*unpack(r.pairs, r.n_pairs, 2)))
                doc, times = (np.concatenate(c) for c in zip(*unpack(r.records, r.n_records, 2)))
                place = np.repeat(np.searchsorted(codes, np.cumsum(step)), per_pair)
                sums, bests = np.zeros(r.n_docs, np.int64), np.zeros(r.n_docs, np.int64)
                np.add.at(sums, doc, counts[place] * times)
                np.add.at(bests, doc, best[place] * times)
                rows.append((r.block, pack(sums, bests), r.n_docs))
        return pd.DataFrame(rows, columns=["block", "given", "n_docs"])

    keys = ["radix", "group"]
    parts = runs.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(run, "block bigint, given binary, n_docs int")

    def add(key, group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n_docs"].iloc[0])
        total = np.zeros((2, n), np.int64)
        for given in group["given"]:
            total += np.concatenate(list(unpack(given, n, 2)), axis=1) if n else 0
        return pd.DataFrame([(key[0], total[0], total[1])], columns=["block", "sums", "bests"])

    return parts.groupBy("block").applyInPandas(add, "block bigint, sums array<bigint>, bests array<bigint>")


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX,
                     block_chars: int = BLOCK_CHARS, fan_in: int = FAN_IN, byte_level: str = BYTE_LEVEL,
                     pieces: str = PIECES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per input row.

    Tokens of a space and the text by A, of the text by B. Groups end where tokens of both end; links are all pairs of tokens
    that share bytes; a pair's count is the number of documents that hold it linked. ``n_best`` counts the links whose
    pair has the highest count of its A id, ``count_sum`` adds up the counts of all links.

    Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: zeros and an empty
    digest. Rows repeated with equal id and text are documents of their own; null ids stay null. Very long texts are
    encoded whole and are blocks of their own. An empty table gives an empty result. Other columns are not read.
    """
    blocks = stash(blocks_of(docs, id_col, text_col, radix, block_chars, byte_level, pieces), "aligned-blocks")
    groups = max(1, ceil(blocks.count() / fan_in))
    blocks = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    runs = blocks.select("group", F.inline("runs")).select("radix", "group", "pairs", "n_pairs")
    runs = _merge(runs, ["radix", "group"], merged)
    left = groups
    while left > fan_in:
        left = ceil(left / fan_in)
        runs = stash(runs, "aligned-runs").withColumn("group", (F.col("group") % left).cast("int"))
        runs = _merge(runs, ["radix", "group"], merged)
    final = stash(_merge(runs, ["radix"], marked), "aligned-pairs")
    given = _contributions(blocks, final, groups)
    whole = blocks.select("block", "docs").join(given, "block", "left")
    none = F.array_repeat(F.lit(0).cast("long"), F.size("docs"))
    rows = whole.select(F.inline(F.arrays_zip(
        F.col("docs").alias("d"), F.coalesce("sums", none).alias("count_sum"), F.coalesce("bests", none).alias("n_best"))))
    return rows.select("d.doc_id", "d.n_a", "d.n_b", "d.n_groups", "d.n_links", "n_best", "count_sum", "d.groups_sha256")


ship_by_value(__name__)
