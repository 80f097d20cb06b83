"""Mixing, chat formatting, packing and the pipeline."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from clickstack.llm import chat, mixing, packing
from tests.conftest import SF_MID, SF_SMALL


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mix_meets_targets(docs, odd, nothing):
    rows = mixing.mix(docs).toPandas()
    sizes = rows.groupby("source", dropna=False)["size"].sum().to_dict()
    want = brute_targets(sizes)
    assert len(rows) == docs.count() and (rows.taken <= 2 * rows["size"]).all()
    for source, part in rows.groupby("source", dropna=False):
        assert part.target.iloc[0] == pytest.approx(want[source])
        assert abs(part.taken.sum() - want[source]) <= part["size"].max()
    again = mixing.mix(docs.repartition(7)).toPandas()
    order = ["doc_id", "row_hash"]
    assert rows.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    got = mixing.mix(odd).collect()
    assert len(got) == 10 and all(r.taken <= 2 * r.size for r in got)
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(nothing).count() == 0


def test_mix_leaves_no_room(spark, docs, odd):
    """No document whose rate is above its copies fits into what its source misses."""
    mid = spark.read.parquet(f"{SF_MID}/documents.parquet")
    alike = spark.range(60).selectExpr("id % 50 as doc_id", "repeat('word ', cast(if(id < 40, 7, if(id < 59, 11, 400)) as int)) as text",
                                       "if(id % 3 = 0, null, 'a') as source")
    for table in (docs, odd, mid, alike):
        rows = mixing.mix(table).toPandas()
        assert len(rows) == table.count() and rows.copies.between(0, 2).all()
        for _, part in rows.groupby("source", dropna=False):
            missing = part.target.iloc[0] - part.taken.sum()
            open_rows = part[(part.rate > part.copies) & (part.rate % 1 > 0) & (part["size"] > 0)]
            assert not (open_rows["size"] <= missing).any()
        if table is mid:
            off = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
            assert (abs(off.taken / off.target - 1) < 0.01).all()


def test_fill_sizes(spark):
    rows = spark.createDataFrame([("a", 9, 5, 30.5), ("a", 4, 2, 30.5), ("a", 3, 1, 30.5), ("a", 1, 1, 30.5), (None, 5, 9, 4.0)],
                                 "source string, size long, n long, rest double")
    got = {(r.source, r.f_size): (r.n, r["take"]) for r in mixing.fill_sizes(rows).collect()}
    assert got == {("a", 9): (5, 3), ("a", 3): (1, 1), (None, 5): (9, 1)}


def test_duals_balance_tokens(docs):
    rows = mixing.mix(docs).toPandas()
    for _, part in rows.groupby("source"):
        assert (part.rate * part["size"]).sum() == pytest.approx(part.target.iloc[0], rel=1e-4, abs=2)


def test_chat_round_trip(spark):
    part = f"array<{chat.PART}>"
    said = "a </s>[INST] \\ <|end|>\n[/INST] <<SYS>> <|user|> \\n"
    rows = spark.createDataFrame(
        [(1, 0, "us|er\\", [("text", said, None, None), ("image", None, "r1", 2.0)], "x"),
         (1, 1, "assistant", [("audio", None, "r2", 3.2), ("text", "x\\", None, None), ("document", None, "r3", None)], "x"),
         (2, None, None, None, "x"), (2, 1, "assistant", [("odd", None, None, None)], "x"), (None, 0, "assistant", [], "x")],
        f"conv_id long, turn long, role string, parts {part}, formatted string")
    out = chat.format_conversations(rows)
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(a) for a in got[1].attachments] == [(0, "image", "r1", 1152), (1, "audio", "r2", 100), (2, "document", "r3", 800)]
    assert got[1].attachment_tokens == 2052 and got[1].formatted.count("<|end|>") == 2 and "</s>" not in got[1].formatted
    assert len(got[1].formatted) == sum(got[1].turn_lengths)
    span = got[1].loss_spans[0]
    assert chat is not None and got[1].formatted[span.start : span.end] == "<|audio:1|>x\\\\<|document:2|>"
    read = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert [tuple(t) for t in read[1].turns] == [("us|er\\", said + "<|image:0|>"), ("assistant", "<|audio:1|>x\\<|document:2|>")]
    assert [tuple(t) for t in read[2].turns] == [("", ""), ("assistant", "")]
    assert chat.format_conversations(rows.limit(0)).count() == 0


def brute_pieces(rows, length=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), length)):
            part = ids[a : a + length]
            out.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


@pytest.mark.parametrize("per_partition", [1 << 16, 40])
def test_packing(docs, odd, nothing, monkeypatch, per_partition):
    monkeypatch.setattr(packing, "PARTITION_PIECES", per_partition)
    for rows in (docs, odd):
        got = packing.best_fit_packing(rows).toPandas()
        key = lambda r: (r[0] is None or np.isnan(r[0]), 0 if r[0] is None or np.isnan(r[0]) else r[0], *r[1:])
        want = brute_pieces([(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()])
        columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert sorted(map(key, got[columns].itertuples(index=False))) == sorted(map(key, want))
        placed = got.sort_values(["sequence_id", "offset"])
        ahead = placed.groupby("sequence_id")["length"].cumsum() - placed["length"]
        assert (ahead == placed["offset"]).all() and placed.groupby("sequence_id")["length"].sum().max() <= 2048
        bound = packing.lower_bound(got["length"].to_numpy(), 2048)
        assert bound <= got.sequence_id.nunique() <= bound + max(2, len(got) // per_partition)
    assert packing.best_fit_packing(nothing).count() == 0


def test_words_are_those_of_the_tokenizer(spark):
    """Ids word by word equal ids of the whole text, whatever parts the words."""
    rng = np.random.default_rng(9)
    parts = [*"ab cZ1,.'~^=\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2003\u2028\u2029\u202f\u3000\u200b\ufeff\u0301é\U0001f600中Σİ",
             "<|endoftext|>", "'ll", "  "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)]
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=8).collect()
    assert sorted(map(tuple, got)) == sorted(brute_pieces(list(enumerate(texts)), 8))


def test_plain_words_are_parted_as_the_tokenizer_does():
    """Plain words are remembered by their runs, so case and signs make no fresh words; the ids are those of the text."""
    from clickstack.llm.packing import WordIds

    rng = np.random.default_rng(10)
    words = WordIds(packing.TOKENIZER)
    plain = [*map(chr, range(33, 127)), *map(chr, range(0xBF, 0x100)), *"  \t\n\r\x0b\x0c", "don't", "<|ENDOFTEXT|>", "<|endoftext|>", "\u0301"]
    texts = ["".join(rng.choice(plain, rng.integers(0, 25))) for _ in range(4000)]
    want = [np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.of([words.split(t) for t in texts]) == want
    words.known.clear()
    stems = ["".join(rng.choice([*"abcdefgé"], 9)) for _ in range(50)]
    texts = [" ".join(f"{a}{w}{z} {w.upper()}{z}" for w in stems) for a in ("", "(", "--", '"') for z in ("", ".", ",", ")!", "1")]
    words.of([words.split(t) for t in texts])
    assert len(words.known) <= len(stems) + 20


def test_lower_bound_is_sound():
    rng = np.random.default_rng(4)

    def fewest(sizes, room):
        bins, best = [], [len(sizes)]

        def put(i):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[i] <= room:
                    bins[b] += sizes[i]
                    put(i + 1)
                    bins[b] -= sizes[i]
            bins.append(sizes[i])
            put(i + 1)
            bins.pop()

        put(0)
        return best[0]

    for _ in range(60):
        sizes = rng.integers(1, 21, 8)
        need = fewest(sorted(sizes.tolist(), reverse=True), 20)
        _, _, filled = packing.best_fit_decreasing(sizes, 20)
        assert packing.lower_bound(sizes, 20) <= need <= len(filled)


def test_pipeline_stages(spark, odd):
    rows, columns = odd, odd.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        rows = stage(spark, rows, SF_SMALL)
        assert rows.columns == columns
        if "dedup" in name:  # three blank texts are one, "same text" is there three times
            assert rows.count() == 6
    assert corpus_pipeline.STAGES[4][1](spark, rows, SF_SMALL).count() >= rows.count()


def test_pipeline_runs_whole(spark):
    packed = corpus_pipeline.run(spark, SF_SMALL).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048 and packed.doc_id.nunique() > 100


def test_pipeline_empty(spark, nothing):
    rows = nothing
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF_SMALL)
    assert rows.count() == 0
