"""SimHash near-duplicates with multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within ``max_bits`` bits differ in at most
``max_bits // segments`` bits in at least one segment, so every fingerprint is filed under its exact
segment values and looks up the small Hamming ball around each of them. Rows that meet under one
table key are compared by their complete distance.

Of two fingerprints with different segment values the smaller value probes the larger, so no pair is
looked up twice. Keys under which at most one fingerprint lies are dropped before anything is
gathered. A bucket passes on a spanning forest of its links, never all its pairs; a bucket beyond
``CHUNK`` rows is cut into chunks that are compared two by two in tasks of their own, which loses no
link. Exact copies share a fingerprint and are folded before the search.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstack.llm.base import ship_by_value, stash, text_of
from clickstack.llm.components import components

SEED = 42
#: Fingerprints that one comparison holds on each side.
CHUNK = 2048
#: Shingles hashed before their bits are summed.
FLUSH_SHINGLES = 1 << 19


def _lanes() -> np.ndarray:
    """For each byte value, eight one-byte lanes holding its bits, lowest first."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").ravel()


def majority_bits(hashes: np.ndarray, sizes: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint per run of ``sizes`` hashes: a bit is set when over half have it."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    # Lanes hold sums up to 255, so each text is summed in slices of at most 255 hashes.
    n = sizes[full]
    slices = -(-n // 255)
    ends = np.cumsum(n)
    first = np.cumsum(slices) - slices
    within = np.arange(slices.sum()) - np.repeat(first, slices)
    cuts = np.repeat(ends - n, slices) + within * 255
    octets = hashes.view(np.uint8).reshape(-1, 8)
    sums = np.empty((len(cuts), 8), np.uint64)
    for j in range(8):
        sums[:, j] = np.add.reduceat(lanes[octets[:, j]], cuts)
    counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64).astype(np.int64), first, axis=0)
    bits = counts * 2 > n[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of every run of ``shingle`` words, of the whole sequence if there are fewer, of none
    if there are no words. Only A-Z are lower-cased; words are split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), SEED)]
    return [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp``: the 64-bit SimHash of every text (as a signed long); ``text_hash`` tells
    rows with equal ids apart."""

    def run(batches):
        lanes = _lanes()
        for batch in batches:
            ids, sizes, hashes, parts = batch.column(0), [], [], []

            def flush():
                parts.append(majority_bits(np.array(hashes, np.uint64), np.array(sizes, np.int64), lanes))
                hashes.clear()
                sizes.clear()

            for text in batch.column(2):
                own = shingle_hashes(text.as_py(), shingle)
                sizes.append(len(own))
                hashes.extend(own)
                if len(hashes) >= FLUSH_SHINGLES:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(1), pa.array(np.concatenate(parts).view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _ball(bits: int, radius: int) -> list[int]:
    """Masks with one to ``radius`` of ``bits`` bits set."""
    return [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]


def _forest(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each value and the smallest value it can reach through links within ``values``."""
    labels = np.arange(len(values))
    step = max(1, (1 << 21) // max(1, len(values)))
    while True:
        before = labels.copy()
        for a in range(0, len(values), step):
            near = np.bitwise_count(values[a : a + step, None] ^ values[None, :]) <= max_bits
            labels[a : a + step] = np.where(near, labels[None, :], len(values)).min(axis=1)
        labels = labels[labels]
        if np.array_equal(before, labels):
            return values, values[labels]


def links(prints: DataFrame, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """``u, v``: a spanning set of the links between distinct fingerprints ``fp`` at most
    ``max_bits`` bits apart: two fingerprints are joined by a path exactly if links join them."""
    width = 64 // segments
    widths = [width + (64 - width * segments) * (j == segments - 1) for j in range(segments)]
    own, probes = [], []

    def around(j: int, value, bits: int):
        """Keys of segment ``j`` near ``value`` and above it."""
        masks = F.array(*[F.lit(m).cast("long") for m in _ball(bits, max_bits // segments)])
        above = F.filter(F.transform(masks, lambda m: value.bitwiseXOR(m)), lambda k: k > value)
        return F.transform(above, lambda k: F.struct(F.lit(j).alias("j"), k.alias("key"), F.lit(0).alias("filed")))

    for j, bits in enumerate(widths):
        value = F.shiftrightunsigned("fp", j * width).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        own.append(F.struct(F.lit(j).alias("j"), value.alias("key"), F.lit(1).alias("filed")))
        if max_bits // segments:
            probes.append(around(j, value, bits))
    filed = F.concat(F.array(*own), *probes) if max_bits // segments else F.array(*own)
    rows = prints.select("fp", F.explode(filed).alias("t")).select("t.*", "fp")
    live = stash(
        rows.groupBy("j", "key").agg(F.sum("filed").alias("filed"), F.count(F.lit(1)).alias("n"))
        .where("filed >= 1 and n >= 2").select("j", "key", "n"), "simhash-live")
    # Chunk c of a large bucket takes part in the comparisons (min(c, d), max(c, d)) for every d.
    chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("long")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda d: F.struct(
        F.least(F.col("c"), d).alias("a"), F.greatest(F.col("c"), d).alias("b")))
    dealt = (
        rows.join(live, ["j", "key"]).withColumn("chunks", chunks).withColumn("c", chunk)
        .select("j", "key", "fp", F.explode(pairs).alias("p")).select("j", "key", "p.a", "p.b", "fp"))

    def compare(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            keys = pdf[["j", "key", "a", "b"]].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            rest = pdf.iloc[cuts[-1] :]
            yield _linked(pdf["fp"].to_numpy().view(np.uint64), cuts)
        if rest is not None:
            yield _linked(rest["fp"].to_numpy().view(np.uint64), np.array([0, len(rest)]))

    def _linked(fps: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
        us, vs = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a == 2:
                if int(fps[a] ^ fps[a + 1]).bit_count() <= max_bits:
                    us.append(fps[a : a + 1])
                    vs.append(fps[a + 1 : a + 2])
            elif b - a > 2:
                u, v = _forest(np.unique(fps[a:b]), max_bits)
                us.append(u[u != v])
                vs.append(v[u != v])
        join = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"u": join(us), "v": join(vs)})

    keys = ["j", "key", "a", "b"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "u long, v long")


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 3, segments: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id, text_hash``.

    Fingerprints at most ``max_bits`` bits apart are linked, links are followed through other
    documents, and ``component_id`` is the smallest id that can be reached.

    Null and wordless texts have fingerprint zero and are linked like any other. Texts with fewer
    words than a shingle are one shingle. Repeated rows share a fingerprint. Null ids are never a
    component's smallest unless all its ids are null. An empty table gives an empty result; other
    columns, whatever their names, are not read.
    """
    prints = stash(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    distinct = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    linked = components(links(distinct.select("fp"), max_bits, segments))
    members = linked.select(F.col("node").alias("fp"), "root").unionByName(
        linked.select(F.col("root").alias("fp"), "root").distinct())
    roots = members.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component"))
    known = stash(members.join(roots, "root").select("fp", "component"), "simhash-components")
    whole = distinct.join(known, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return prints.join(whole, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


ship_by_value(__name__)
