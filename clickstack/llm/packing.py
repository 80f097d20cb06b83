"""Best-fit packing with certified bounds.

Documents are tokenised and cut into pieces of at most one sequence. Pieces are dealt over bounded
partitions, each packed by best-fit decreasing. Dual-feasible functions give a lower bound on the
bins a partition needs; a partition whose bin count meets its bound is certified and done. From
partitions with a gap, the pieces of all bins that are not full are exchanged: dealt anew over fewer
partitions, together, and packed again. A round that needs no fewer bins ends the exchange.

A task holds one partition of pieces (a few numbers each); token ids stay in the tokenising pass, only
their checksums travel. A document that repeats, or a source that holds a third of the rows, is dealt
by a hash of the piece and so spreads evenly.
"""

from __future__ import annotations

import json
import re
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstack.llm.base import process_cache, ship_by_value, stash, text_of

#: Sequence length; id put after each document; tokenizer file, looked up where it is used.
LENGTH = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Pieces per partition on average, rounds of exchange at most, words a worker remembers.
PARTITION_PIECES = 1 << 16
ROUNDS = 4
MEMORY = 1_000_000
#: Characters of which one that no fresh word holds parts the words given to the tokenizer.
PARTS = "~^_=+;:?#*@%&$!"
#: Python's split() also parts at these four, which the tokenizer takes for symbols.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: How the tokenizer parts what it has lower-cased: contractions, letters, single digits, signs.
PARTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LOWERING = ["NFC", "Replace", "Lowercase"]
#: Characters that can be parted here with the same result: Latin letters, which lower-case one to one and compose
#: with nothing, digits and signs, but not the apostrophe of contractions and the "<" of special tokens.
PLAIN_SET = r"0-9A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:;=-@\[-`{-~"
PLAIN = re.compile(f"[{PLAIN_SET}]+")
PLAIN_TEXT = re.compile(rf"[{PLAIN_SET} \t\n\r\x0b\x0c]*")
RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ \t\n\r\x0b\x0c]+")


def split_words(text: str) -> list[str]:
    """The runs of anything but Unicode white space."""
    if any(c in text for c in SEPARATORS):
        return re.findall(r"(?:[\x1c-\x1f]|\S)+", text)
    return text.split()


def parts_words(tokenizer) -> bool:
    """Whether the tokenizer lower-cases and parts words as ``RUNS`` does."""
    kind = lambda part: json.loads(part.__getstate__()) if part else {}
    lowering, parting = kind(tokenizer.normalizer), kind(tokenizer.pre_tokenizer)
    first, *rest = parting.get("pretokenizers") or [{}]
    return ([n["type"] for n in lowering.get("normalizers", [])] == LOWERING
            and first.get("pattern") == {"Regex": PARTING} and first.get("behavior") == "Removed" and first.get("invert") is True
            and [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)])


class WordIds:
    """Ids of words, as bytes. The tokenizer never joins across white space, so the ids of a text are those
    of its words in order, and those of a plain word are those of its runs of letters, digits and signs. Fresh
    ones go to the tokenizer together, parted by a mark that none holds."""

    def __init__(self, tokenizer: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.known: dict[str, bytes] = {}
        self.letters = None
        if parts_words(self.tokenizer):
            # Lower-cased letters need no normalizer and hold no special token.
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = self.tokenizer.pre_tokenizer

    def split(self, text: str) -> list[str]:
        """What the ids of a text are remembered by: plain words as lower-cased runs, others whole."""
        if self.letters is None:
            return split_words(text)
        if PLAIN_TEXT.fullmatch(text):
            return RUNS.findall(text.lower())
        out: list[str] = []
        for w in split_words(text):
            if PLAIN.fullmatch(w):
                out += RUNS.findall(w.lower())
            else:
                out.append(w)
        return out

    @staticmethod
    def _ids(tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode(self, tokenizer, fresh: list[str]) -> None:
        known = self.known
        for at in range(0, len(fresh), 512):
            part = fresh[at : at + 512]
            joined = "".join(part)
            mark = next((c for c in PARTS if c not in joined and len(self._ids(tokenizer, c)) == 1), None)
            if mark is None:
                for w in part:
                    known[w] = np.array(self._ids(tokenizer, w), "<u4").tobytes()
                continue
            code = self._ids(tokenizer, mark)[0]
            ids = np.array(self._ids(tokenizer, f" {mark} ".join(part)), "<u4")
            cuts = np.flatnonzero(ids == code)
            if len(cuts) != len(part) - 1:
                raise ValueError("the tokenizer joined words across white space")
            starts, ends = np.r_[0, cuts + 1].tolist(), np.r_[cuts, len(ids)].tolist()
            raw = ids.tobytes()
            known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, starts, ends))

    def learn(self, words: set[str]) -> None:
        known = self.known
        fresh = [w for w in words if w not in known]
        if len(known) + len(fresh) > MEMORY:
            known.clear()
            fresh = list(words)
        if self.letters is not None:
            plain = [w for w in fresh if w.isalpha() and PLAIN.fullmatch(w)]
            self._encode(self.letters, plain)
            fresh = [w for w in fresh if w not in known]
        self._encode(self.tokenizer, fresh)

    def of(self, texts: list[list[str]]) -> list[bytes]:
        self.learn(set(chain.from_iterable(texts)))
        look = self.known.__getitem__
        return [b"".join(map(look, words)) for words in texts]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
           end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents as token ids with ``end_id`` after
    each, cut where they exceed ``length``."""

    def run(batches):
        cache = process_cache(f"word-ids:{tokenizer}")
        if "ids" not in cache:
            cache["ids"] = WordIds(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * length
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for at in range(0, len(ids), 500):
                texts = [cache["ids"].split(t or "") for t in batch.column(1)[at : at + 500].to_pylist()]
                for doc, raw in zip(ids[at : at + 500], cache["ids"].of(texts)):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), step)):
                        part = raw[a : a + step]
                        rows.append((doc, k, a // 4, len(part) // 4, crc32(part)))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of two families of dual-feasible functions, over every threshold that can matter.

    The first counts pieces above ``capacity - t`` as whole, drops those below ``t`` and keeps the rest; the
    second rounds sizes to multiples of ``1 / k``. Any packing needs as many bins as either sums to."""
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    total, words = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(0, capacity // 2 + 1)
    big = total[-1] - total[capacity - t]
    middle = words[capacity - t] - np.where(t > 0, words[np.maximum(t - 1, 0)], 0)
    best = int((big + -(-middle // capacity)).max())
    for k in range(2, 21):
        scaled = (k + 1) * size
        # u_k(x) = x where (k+1)x is whole, else floor((k+1)x) / k; both in units of 1 / (k (k+1)).
        value = np.where(scaled % capacity == 0, scaled // capacity * k, scaled // capacity * (k + 1))
        best = max(best, int(-(-(value * count).sum() // (k * (k + 1)))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every piece, and what is filled of every bin. Each piece, largest first, goes into
    the fullest bin that still takes it."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms, filled = 0, []  # rooms: bit r set when some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        left = room - size
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(filled, np.int64)


def _dealt(rows: DataFrame, parts: int, salt: int) -> DataFrame:
    key = F.xxhash64(F.lit(salt), "doc_id", "piece", "ids_crc32", "draw")
    return rows.withColumn("part", F.pmod(key, F.lit(parts)))


def pack(items: DataFrame, length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``; every piece of ``length`` column ``length`` is
    placed once, sequences are filled from 0 without gaps."""
    columns = items.columns
    items = stash(items.withColumn("draw", F.monotonically_increasing_id()), "packing-pieces")
    schema = ", ".join(f"{c} {t}" for c, t in items.dtypes) + ", part long, sequence_id long, offset long, fill long, bins long, bound long"

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32", "draw"], kind="stable")
        sizes = pdf["length"].to_numpy()
        bins, offsets, filled = best_fit_decreasing(sizes, length)
        return pdf.assign(sequence_id=bins, offset=offsets, fill=filled[bins], bins=len(filled),
                          bound=lower_bound(sizes, length))

    done, open_rows, fewest = [], items, None
    for k in range(rounds + 1):
        n = open_rows.count()
        if not n:
            break
        parts = max(1, -(-n // PARTITION_PIECES))
        out = stash(_dealt(open_rows, parts, k).groupBy("part").applyInPandas(packed, schema), f"packing-round{k}")
        per = out.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        total = per.agg(F.sum("bins").alias("b"), F.sum(F.col("bins") - F.col("bound")).alias("gap"), F.count(F.lit(1)).alias("p")).first()
        placed = out.withColumn("round", F.lit(k))
        # A round that only moved pieces about is not kept: the packing before it stands.
        if fewest is not None and total.b >= fewest:
            break
        if done:
            done[-1] = done[-1].where(~F.col("open"))
        gap = F.col("bins") > F.col("bound")
        last = total.gap == 0 or total.p == 1 or k == rounds
        open_flag = F.lit(False) if last else gap & (F.col("fill") < length)
        done.append(placed.withColumn("open", open_flag))
        if last:
            break
        open_rows = out.where(gap & (F.col("fill") < length)).select(*items.columns)
        fewest = out.where(gap & (F.col("fill") < length)).select("part", "sequence_id").distinct().count()
    if not done:
        return items.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    # Bin numbers stay under 2^24: a partition holds about PARTITION_PIECES pieces.
    number = F.shiftleft(F.col("part") * (ROUNDS + 1) + F.col("round"), 24) + F.col("sequence_id")
    return whole.select(*columns, number.alias("sequence_id"), "offset")


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                     end_id: int = END_ID, tokenizer: str = TOKENIZER, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece that holds ``end_id`` alone. Very long texts are cut into pieces of
    ``length`` ids. Repeated rows are packed one by one. An empty table gives an empty result. Only the id
    and the text are read."""
    return pack(pieces(docs, id_col, text_col, length, end_id, tokenizer), length, rounds)


ship_by_value(__name__)
