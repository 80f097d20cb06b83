"""Personal data by a character-level bidirectional LSTM with CRF transitions.

Base spans come from four plain patterns. The tagger adds spans that the patterns miss: it reads characters
both ways, and a linear chain over its emissions tags them outside, or beginning or inside a kind. It is trained in
numpy from labelled spans: lines written by rules (``labelled_spans``) and a bounded sample of the corpus's own windows,
marked by the base patterns.

Texts are cut into overlapping windows, each decoded on its own. A span decoded in several windows has one vote of
each that sees it whole; the spans of all windows of a text compete, and the set with the largest total of their
marginals stays, without overlaps between them or with base spans. Every kind holds a digit or an "@", so windows
without either are outside by the chain's own constraints and are not run.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstack.llm import labelled_spans
from clickstack.llm.base import ship_by_value, text_of
from clickstack.llm.labelled_spans import KINDS

#: Characters of a window; each starts half a window after the one before.
WINDOW = 96
#: Characters of a training line's window.
TRAIN_WINDOW = 64
#: Training bounds: written lines, windows of the corpus, code points of their texts read for them.
TRAIN_LINES, TRAIN_ROWS, TRAIN_CHARS = 4500, 300, 1_500_000
EMBED, HIDDEN, EPOCHS, BATCH, RATE = 16, 24, 13, 128, 0.015
#: Least mean marginal of a span that is added, and characters that a span of a kind has at least.
CONFIDENCE = 0.9
LEAST = {"email": 6, "ip": 7, "card": 14, "phone": 10}
#: Windows run together.
TOGETHER = 512

TAGS = 1 + 2 * len(KINDS)  # outside, then beginning and inside of each kind
SEED = re.compile(r"[0-9@]")

IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d) // 10 + (2 * d) % 10
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns, leftmost and without overlaps within a kind, by start and kind. Time is linear
    in the text: a run of digits or of name characters is read once, whatever follows it."""
    found: list[tuple[int, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            found.append((start, 0, end))
        else:
            end = max(end, start)  # a name that led to nothing is not read again
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


# --- the tagger -----------------------------------------------------------------------------------

def codes(text: str) -> np.ndarray:
    """A small number per character: ASCII as it is, others by what they are."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    high = points >= 128
    if high.any():
        points = points.copy()
        points[high] = [128 + (c.isalpha() + 2 * c.isdigit() + 4 * c.isspace()) for c in np.array(list(text))[high]]
    return points


ALPHABET = 128 + 8 + 1  # the last one fills up short windows


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties of transitions and of first tags: the inside of a kind follows its beginning or inside."""
    move, first = np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        move[:, inside] = -1e4
        move[inside - 1, inside] = move[inside, inside] = 0
        first[inside] = -1e4
    return move, first


class Tagger:
    """Embeddings, one LSTM each way, emissions, transitions and first tags."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 7) -> "Tagger":
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape)
        # Characters of one sort start alike: what is learnt of a digit or a letter holds for the others.
        sorts = [chr(c) if not chr(c).isalnum() else "0" if chr(c).isdigit() else "a" if chr(c).islower() else "A" for c in range(128)]
        by_sort = {k: rng.normal(0, 1, EMBED) for k in dict.fromkeys(sorts)}
        embed = np.concatenate([[by_sort[k] for k in sorts], rng.normal(0, 1, (ALPHABET - 128, EMBED))])
        bias = np.tile(np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)], (2, 1, 1))  # forget gates start open
        w = {"embed": embed + rng.normal(0, 0.1, embed.shape), "in": draw(2, EMBED, 4 * HIDDEN), "again": draw(2, HIDDEN, 4 * HIDDEN),
             "bias": bias, "out": draw(2 * HIDDEN, TAGS), "out_bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _read(self, seen: np.ndarray, keep: bool = False):
        """Hidden states, (time, window, both ways), over (time, window, embedding); what the way back needs if ``keep``. Both
        ways advance together, the second one over the time turned round."""
        steps, n, _ = seen.shape
        both = np.stack([seen, seen[::-1]], axis=1)  # time, way, window, embedding
        gates = both @ self.w["in"] + self.w["bias"]
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        states, held = np.empty((steps, 2, n, HIDDEN), np.float32), []
        for t in range(steps):
            g = gates[t] + h @ self.w["again"]
            g[..., : 3 * HIDDEN] *= 0.5
            np.tanh(g, out=g)
            gate = 0.5 * g[..., : 3 * HIDDEN] + 0.5  # the logistic function
            i, f, o, u = gate[..., :HIDDEN], gate[..., HIDDEN : 2 * HIDDEN], gate[..., 2 * HIDDEN :], g[..., 3 * HIDDEN :]
            before, c = c, f * c + i * u
            top = np.tanh(c)
            if keep:
                held.append((gate, i, f, o, u, before, top, h))
            h = o * top
            states[t] = h
        return np.concatenate([states[:, 0], states[::-1, 1]], axis=2), both, held

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores of the tags, (time, window, tag), of windows of character codes (window, time)."""
        return self._read(self.w["embed"][x.T])[0] @ self.w["out"] + self.w["out_bias"]

    def _chain(self, scores: np.ndarray, real: np.ndarray):
        """Forward and backward messages (logarithms) and each window's total; time past a window's end changes nothing."""
        move, first = allowed()
        move, first = move + self.w["move"], first + self.w["first"]
        steps, n, _ = scores.shape
        ahead, back = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = first + scores[0]
        for t in range(1, steps):
            both = ahead[t - 1][:, :, None] + move
            top = both.max(axis=1)
            step = top + np.log(np.exp(both - top[:, None, :]).sum(axis=1)) + scores[t]
            ahead[t] = np.where(real[t][:, None], step, ahead[t - 1])
        for t in range(steps - 2, -1, -1):
            both = move + (scores[t + 1] + back[t + 1])[:, None, :]
            top = both.max(axis=2)
            step = top + np.log(np.exp(both - top[:, :, None]).sum(axis=2))
            back[t] = np.where(real[t + 1][:, None], step, back[t + 1])
        top = ahead[-1].max(axis=1)
        return ahead, back, top + np.log(np.exp(ahead[-1] - top[:, None]).sum(axis=1)), move

    def marginals(self, scores: np.ndarray, real: np.ndarray) -> np.ndarray:
        ahead, back, total, _ = self._chain(scores, real)
        return np.exp(ahead + back - total[:, None])

    def decode(self, scores: np.ndarray, real: np.ndarray) -> np.ndarray:
        """The best tags of each window, (time, window)."""
        move, first = allowed()
        move, first = move + self.w["move"], first + self.w["first"]
        steps, n, _ = scores.shape
        best, come = first + scores[0], np.zeros(scores.shape, np.int64)
        for t in range(1, steps):
            both = best[:, :, None] + move
            come[t] = both.argmax(axis=1)
            best = np.where(real[t][:, None], both.max(axis=1) + scores[t], best)
        tags = np.zeros((steps, n), np.int64)
        now, rows = best.argmax(axis=1), np.arange(n)
        for t in range(steps - 1, -1, -1):
            tags[t] = np.where(real[t], now, 0)
            now = np.where(real[t], come[t][rows, now], now)
        return tags

    def gradient(self, x: np.ndarray, gold: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss per window (negative log-likelihood of the gold tags) and its gradient."""
        steps, n = gold.shape
        states, both, held = self._read(self.w["embed"][x.T], True)
        scores = states @ self.w["out"] + self.w["out_bias"]
        ahead, back, total, move = self._chain(scores, real)
        chance = np.exp(ahead + back - total[:, None]) * real[:, :, None]
        right = (np.arange(TAGS) == gold[:, :, None]) * real[:, :, None]
        path = (scores * right).sum(axis=(0, 2)) + (self.w["first"] * right[0]).sum(axis=1)
        steps_on = real[1:]
        pair = ahead[:-1, :, :, None] + move + (scores + back)[1:, :, None, :] - total[:, None, None]
        pair = np.exp(np.where(steps_on[:, :, None, None], pair, -np.inf)).sum(axis=(0, 1))
        before, after = gold[:-1][steps_on], gold[1:][steps_on]
        told = np.bincount(before * TAGS + after, minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        path += np.where(steps_on, move[gold[:-1], gold[1:]], 0).sum(axis=0)
        grad = {"first": (chance[0] - right[0]).sum(axis=0) / n, "move": (pair - told) / n}
        by_score = ((chance - right) / n).astype(np.float32)
        grad["out"] = np.tensordot(states, by_score, ((0, 1), (0, 1)))
        grad["out_bias"] = by_score.sum(axis=(0, 1))
        by_state = by_score @ self.w["out"].T
        by_state = np.stack([by_state[..., :HIDDEN], by_state[::-1, :, HIDDEN:]], axis=1)
        grad["again"], again = np.zeros_like(self.w["again"]), self.w["again"].transpose(0, 2, 1)
        by_gates = np.empty((steps, 2, n, 4 * HIDDEN), np.float32)
        by_h, by_c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            gate, i, f, o, u, before, top, h = held[t]
            by_h = by_h + by_state[t]
            by_c = by_c + by_h * o * (1 - top * top)
            g = by_gates[t]
            g[..., : 3 * HIDDEN] = np.concatenate([by_c * u, by_c * before, by_h * top], axis=2) * gate * (1 - gate)
            g[..., 3 * HIDDEN :] = by_c * i * (1 - u * u)
            grad["again"] += h.transpose(0, 2, 1) @ g
            by_h, by_c = g @ again, by_c * f
        flat = lambda z: z.transpose(1, 0, 2, 3).reshape(2, steps * n, -1)
        grad["in"] = flat(both).transpose(0, 2, 1) @ flat(by_gates)
        grad["bias"] = by_gates.sum(axis=(0, 2))[:, None, :]
        by_seen = by_gates @ self.w["in"].transpose(0, 2, 1)
        grad["embed"] = np.zeros_like(self.w["embed"])
        np.add.at(grad["embed"], x.T, by_seen[:, 0] + by_seen[::-1, 1])
        return float((total - path).mean()), grad

    @classmethod
    def fit(cls, windows: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS, seed: int = 7) -> "Tagger":
        """Adam steps over (text of at most a window, its spans) in a fixed random order."""
        out, rng = cls.fresh(seed), np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in out.w.items()} for _ in range(2))
        step = 0
        per = -(-len(windows) // BATCH)
        for _ in range(epochs):
            # Windows of like length together: less filling up.
            order = sorted(rng.permutation(len(windows)).tolist(), key=lambda i: len(windows[i][0]) // 16)
            for b in rng.permutation(per).tolist():
                part = [windows[i] for i in order[b * BATCH : (b + 1) * BATCH]]
                x, real = filled([codes(t) for t, _ in part])
                gold = np.zeros(real.shape, np.int64)
                for j, (_, spans) in enumerate(part):
                    for kind, s, e in spans:
                        gold[s:e, j] = 2 + 2 * KINDS.index(kind)
                        gold[s, j] -= 1
                _, grad = out.gradient(x, gold, real)
                step += 1
                norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
                rate = RATE * (1 - step / (epochs * per + 1))
                for k, g in grad.items():
                    g = g / max(1.0, norm / 5)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    out.w[k] = out.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return out


def filled(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows side by side, (window, time), and which places are real, (time, window)."""
    width = max(map(len, rows))
    x = np.full((len(rows), width), ALPHABET - 1)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x, (np.arange(width)[:, None] < np.array([len(r) for r in rows]))


# --- windows of a text ----------------------------------------------------------------------------

def windows_of(text: str, width: int = WINDOW) -> list[int]:
    """Starts of the windows that hold a digit or an "@": every character is inside of two windows, but for those of the
    first and last half window."""
    half, out = width // 2, []
    halves = sorted({m.start() // half for m in SEED.finditer(text)})
    last = max(0, -(-len(text) // half) - 2)
    for k in halves:
        for start in (k - 1, k):
            start = min(max(start, 0), last)
            if not out or out[-1] < start:
                out.append(start)
    return [k * half for k in out]


def decoded(tagger: Tagger, windows: list[str]) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, mean marginal) of the spans of each window."""
    out = []
    for at in range(0, len(windows), TOGETHER):
        x, real = filled([codes(t) for t in windows[at : at + TOGETHER]])
        scores = tagger.emissions(x)
        tags = tagger.decode(scores, real)
        hot = np.flatnonzero(tags.any(axis=0))
        chance = np.zeros((*tags.shape, TAGS))
        if len(hot):
            chance[:, hot] = tagger.marginals(scores[:, hot], real[:, hot])
        for j in range(tags.shape[1]):
            own, spans, t = tags[:, j], [], 0
            places = np.flatnonzero(own)
            while len(places) and t <= places[-1]:
                if own[t] % 2 == 1:
                    e = t + 1
                    while e < len(own) and own[e] == own[t] + 1:
                        e += 1
                    spans.append((KINDS[own[t] // 2], t, e, float(chance[np.arange(t, e), j, own[t:e]].mean())))
                    t = e
                else:
                    t += 1
            out.append(spans)
    return out


def reconciled(text: str, found: list[tuple[int, list[tuple[str, int, int, float]]]], base: list[tuple[str, int, int]],
               width: int = WINDOW) -> list[tuple[str, int, int]]:
    """The spans that stay out of those decoded in the windows (start, spans) of a text, by a best set of
    spans without overlaps. A span at a cut edge of its window does not count: another window sees it whole."""
    votes: dict[tuple[str, int, int], float] = {}
    for at, spans in found:
        end = min(len(text), at + width)
        for kind, s, e, p in spans:
            cut = (at + s == at and at > 0) or (at + e == end and end < len(text))
            if not cut and p >= CONFIDENCE and sound(kind, text[at + s : at + e]):
                votes[kind, at + s, at + e] = votes.get((kind, at + s, at + e), 0.0) + p * (e - s)
    # Base spans of several kinds can overlap each other; what they cover together is taken.
    covered: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    starts = [s for s, _ in covered]

    def free(s: int, e: int) -> bool:
        k = bisect_right(starts, e - 1)
        return k == 0 or covered[k - 1][1] <= s

    spans = sorted((e, s, KINDS.index(kind), v) for (kind, s, e), v in votes.items() if free(s, e))
    ends, best, chosen = [e for e, *_ in spans], [0.0], [()]
    for i, (e, s, k, v) in enumerate(spans):
        j = bisect_right(ends, s, 0, i)
        take = best[j] + v > best[-1]
        best.append(best[j] + v if take else best[-1])
        chosen.append((j, (KINDS[k], s, e)) if take else (len(best) - 2, None))
    out, i = [], len(spans)
    while i:
        i, span = chosen[i]
        if span:
            out.append(span)
    return out[::-1]


def sound(kind: str, span: str) -> bool:
    """What a span of the kind must hold, whatever the tagger says."""
    digits = sum(c in "0123456789" for c in span)
    if len(span) < LEAST[kind] or span[0] in " \t\n" or span[-1] in " \t\n":
        return False
    if kind == "email":
        return "@" in span and "." in span
    if kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= digits <= 19 and luhn(re.sub(r"[^0-9]", "", span))
    return 10 <= digits <= 15


# --- training and the operator --------------------------------------------------------------------

def written_windows(n: int, seed: int, width: int = WINDOW) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows out of written lines, with the spans that they hold whole; half of them start inside a line."""
    rng, out = np.random.default_rng(seed), []
    for parts in labelled_spans.lines(n, seed):
        text, spans = "", []
        for piece, kind in parts:
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece
        start = int(rng.integers(0, max(1, len(text) - width // 2))) if rng.random() < 0.5 else 0
        cut = [s for s in spans if s[1] < start < s[2] or s[1] < start + width < s[2]]
        if not cut:
            out.append((text[start : start + width], [(k, s - start, e - start) for k, s, e in spans if s >= start and e <= start + width]))
    return out


def corpus_windows(docs: DataFrame, id_col: str, text_col: str, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS,
                   width: int = WINDOW) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows around the base spans, and around other digits, of at most ``rows`` texts with at most ``chars`` code points
    together, chosen by a hash of the id: a bounded sample. Texts that alone pass an even share are left to others."""
    share = max(1, chars // max(1, rows))
    drawn = docs.select(F.xxhash64(F.lit("spans"), F.col(id_col).cast("long")).alias("draw"), text_of(text_col).alias("text")).where(
        (F.length("text") <= share) & F.col("text").rlike("[0-9]"))
    # First the draws alone, then the texts of those: no task sends more texts than are taken of it.
    last = drawn.select("draw").orderBy("draw").limit(rows).agg(F.max("draw")).first()[0]
    picked = drawn.where(F.col("draw") <= F.lit(last)).orderBy("draw", "text").limit(rows)
    out = []
    for r in picked.collect():
        spans = base_spans(r.text)
        for start in windows_of(r.text, width)[:8]:
            end = start + width
            if not any(s < start < e or s < end < e for _, s, e in spans):
                inside = [(k, s - start, e - start) for k, s, e in spans if s >= start and e <= end]
                clear = all(a[2] <= b[1] for a, b in zip(inside, inside[1:]))
                if clear and r.text[start:end]:
                    out.append((r.text[start:end], inside))
    return out


def fit_tagger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = TRAIN_LINES, rows: int = TRAIN_ROWS,
               chars: int = TRAIN_CHARS) -> Tagger:
    """A tagger from written lines and a bounded sample of the documents; the same on every run over the same rows."""
    return Tagger.fit(written_windows(lines, 11, TRAIN_WINDOW) + corpus_windows(docs, id_col, text_col, rows, chars))


def find_personal_data(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``, one row per input row.

    The four counts and the digest are of the base spans, ``spans`` lists these and the added ones as
    ``kind:start:end`` (code points, end exclusive) by start, then kind, joined by commas; ``n_added`` counts the latter.
    Null texts count as empty; texts without spans have zeros and the digest of the empty string. Very
    long texts are read whole, window by window. Rows repeated give equal results; null ids stay null; an empty table gives an empty
    result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in tagger.w.items()})  # fixed size

    def run(batches):
        model = Tagger(shared.value)

        def found(texts: list[str]):
            base = [base_spans(t) for t in texts]
            own = [(i, at) for i, t in enumerate(texts) for at in windows_of(t)]
            by_text: list[list] = [[] for _ in texts]
            for (i, at), spans in zip(own, decoded(model, [texts[i][at : at + WINDOW] for i, at in own])):
                if spans:
                    by_text[i].append((at, spans))
            return base, [reconciled(t, w, b) if w else [] for t, w, b in zip(texts, by_text, base)]

        joined = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        order = lambda x: (x[1], KINDS.index(x[0]), x[2])
        nothing = sha256(b"").hexdigest()
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            n = len(texts)
            counts, shas, lists, added = np.zeros((4, n), np.int64), [nothing] * n, [""] * n, np.zeros(n, np.int64)
            hot = [i for i, t in enumerate(texts) if SEED.search(t)]
            for at in range(0, len(hot), 256):
                part = hot[at : at + 256]
                for i, base, more in zip(part, *found([texts[i] for i in part])):
                    for kind, _, _ in base:
                        counts[KINDS.index(kind), i] += 1
                    shas[i] = sha256(joined(base).encode()).hexdigest()
                    lists[i], added[i] = joined(sorted(base + more, key=order)), len(more)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts), pa.array(shas, pa.string()), pa.array(lists, pa.string()), pa.array(added)],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


ship_by_value(__name__)
