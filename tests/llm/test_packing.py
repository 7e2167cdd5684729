import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesela.llm.packing import Encoder, op9, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check(pieces, docs, window=2048):
    """Every document comes back whole, and sequences are gapless; docs: (doc_id, ids)."""
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    lengths = []
    for s in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        lengths.append(at)
    assert all(n == window for n in lengths[:-1])
    assert sorted(by_doc, key=str) == sorted({d for d, _ in docs}, key=str)
    for d, ids in docs:
        assert sum(p.length for p in by_doc[d]) % len(ids) == 0 and all(p.doc_tokens == len(ids) for p in by_doc[d])
    return by_doc


def test_encoder_equals_the_tokenizer(tokenizer):
    texts = ["", " ", "a  b\n\n c", "it's I'LL 12ab  \t", "<|endoftext|> x", "Ciónueta ñas!!", "日本語 text", "a b  c\u0085d", "x" * 5000, "\x00\x1c a", "é́ ﬁ ½²", "  'sa 's"]
    e = Encoder(PATH)
    assert e.fast is not None
    for t in texts * 2:
        assert e(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_every_document_of_the_table(spark, sf, tokenizer):
    docs = [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    by_doc = check(op9(spark, sf).collect(), docs)
    for d, ids in docs:
        assert sorted(p.start for p in by_doc[d])[0] == 0
        for p in by_doc[d]:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())


def by_letters():
    import numpy as np

    return lambda text: np.frombuffer(text.encode(), np.uint8).astype("<u4")  # made here, so that workers get it by value


letters = by_letters()


def test_windows_keep_to_the_sources_shares(spark):
    rows = [(i, "x" * (20 + i % 7), "a" if i % 4 else "b") for i in range(4000)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), "", 1000, encode=by_letters()).collect()
    check(pieces, [(i, [0] * (len(t) + 1)) for i, t, _ in rows], 1000)
    total = sum(len(t) + 1 for _, t, _ in rows)
    want = sum(len(t) + 1 for _, t, s in rows if s == "b") / total
    for s in range(total // 1000):
        assert abs(sum(p.length for p in pieces if p.sequence_id == s and p.source == "b") - 1000 * want) <= 3


def loop(queues, quantum, turn_order):
    """Sources of all tokens in order, by serving queues round after round; a queue sends what its deficit covers."""
    left, deficit, sent, out = dict(queues), dict.fromkeys(queues, 0.0), dict.fromkeys(queues, 0), []
    for r in range(1, 10**6):
        for q in turn_order:
            deficit[q] = r * quantum[q] - sent[q]
            n = min(left[q], max(0, int(np.ceil(deficit[q] - 1e-6))))
            out += [q] * n
            sent[q] += n
            left[q] -= n
        if not any(left.values()):
            return out


def test_schedule_equals_a_looped_round_robin(spark):
    """Long documents and short ones, targets that let queues run dry at different times."""
    rng = np.random.default_rng(5)
    rows = [(i, "x" * int(rng.integers(0, 3000) if i % 9 == 0 else rng.integers(0, 60)), "abc"[i % 3 if i % 2 else 0]) for i in range(600)]
    targets, window = {"a": 0.55, "b": 0.3, "c": 0.15}, 200
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = pack(df, "", window, targets=targets, piece=1, encode=by_letters()).collect()
    check(pieces, [(i, [0] * (len(t) + 1)) for i, t, _ in rows], window)
    turn_order = [r.source for r in df.select("source").distinct().orderBy(F.xxhash64("source")).collect()]
    queues = {q: sum(len(t) + 1 for _, t, s in rows if s == q) for q in turn_order}
    got = [p.source for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) for _ in range(p.length)]
    assert got == loop(queues, {q: targets[q] * window for q in queues}, turn_order)


def test_tiny_shares_save_up_and_hot_sources_hold_their_share(spark):
    """Sixty sources of which one holds a third: every full window stays within one piece a queue of its targets."""
    rows = [(i, "x" * (15 + i % 50), "hot" if i % 3 == 0 else f"s{i % 59}") for i in range(6000)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), "", 512, piece=32, encode=by_letters()).collect()
    check(pieces, [(i, [0] * (len(t) + 1)) for i, t, _ in rows], 512)
    total, hot = sum(len(t) + 1 for _, t, _ in rows), sum(len(t) + 1 for _, t, s in rows if s == "hot")
    held = [sum(p.length for p in pieces if p.sequence_id == s and p.source == "hot") for s in range(total // 512 - 3)]
    assert max(abs(h - 512 * hot / total) for h in held) <= 0.35 * 512 and abs(sum(held) / len(held) - 512 * hot / total) < 8
    assert max(p.length for p in pieces if p.source != "hot") <= 33


def test_a_target_of_zero_comes_last(spark):
    rows = [(i, "x" * 9, "ab"[i % 2]) for i in range(400)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), "", 100, targets={"a": 1.0, "b": 0.0}, encode=by_letters()).collect()
    assert {p.source for p in pieces if p.sequence_id < 20} == {"a"} and {p.source for p in pieces if p.sequence_id > 20} == {"b"}


def test_targets_hold_while_queues_last(spark):
    rows = [(i, "x" * 9, "a" if i % 2 else "b") for i in range(2000)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), "", 100, targets={"a": 0.8, "b": 0.2}, piece=1, encode=by_letters()).collect()
    check(pieces, [(i, [0] * 10) for i, _, _ in rows], 100)
    for s in range(100):
        assert abs(sum(p.length for p in pieces if p.sequence_id == s and p.source == "a") - 80) <= 2


def test_nulls_repeats_long_texts_and_empty(spark):
    schema = "doc_id long, text string, source string, n long, key string, at string, round double"
    assert pack(spark.createDataFrame([], schema), "", encode=by_letters()).count() == 0
    extra = (1, "k", "z", 0.5)
    rows = [(1, None, None, *extra), (2, "", "s", *extra), (3, "y" * 300_000, "s", *extra), (4, "abc", None, *extra), (4, "abc", None, *extra), (4, "other", "s", *extra), (None, "null id", "s", *extra), (None, "null id", "s", *extra)]
    out = pack(spark.createDataFrame(rows, schema), "", 64, encode=by_letters())
    pieces = out.collect()
    assert sum(p.length for p in pieces) == sum(len(r[1] or "") + 1 for r in rows)
    at = sorted((p.sequence_id * 64 + p.offset, p.length) for p in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and at[0][0] == 0
    long = sorted((p.start, p.ids) for p in pieces if p.doc_id == 3)
    assert b"".join(x for _, x in long) == letters("y" * 300_000).tobytes() + np.array([1], "<u4").tobytes()
    assert out.filter(F.col("doc_id") == 4).agg(F.sum("length")).first()[0] == 4 + 4 + 6
