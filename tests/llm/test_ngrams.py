import math
import mmap
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesela.llm.ngrams import NONE, STEP, EliasFano, Trie, op11, scored, tries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, weight=100.0):
    """(doc_id, text, learn) -> (n_tokens, n_known, N, base, score) by dictionaries and exact probabilities."""
    cut = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t, _ in rows]
    learnt = [c for c, (_, _, learn) in zip(cut, rows, strict=True) if learn]
    one = Counter(w for c in learnt for w in c)
    two = Counter(p for c in learnt for p in zip(["\n", *c], c, strict=False))
    before = Counter()
    for (h, _), n in two.items():
        before[h] += n
    total, distinct = sum(one.values()), len(one)
    out = []
    for c in cut:
        base = [(one[w] + 1) / (total + distinct + 1) for w in c]
        full = [(two[h, w] + weight * p) / (before[h] + weight) for h, w, p in zip(["\n", *c], c, base, strict=False)]
        out.append((len(c), sum(one[w] > 0 for w in c), total, sum(map(math.log10, base)), sum(map(math.log10, full))))
    return out


def compare(got, rows, weight=100.0):
    """Codes are off by half a step at most, in either part of each probability."""
    key = lambda r: (r[0] is None, r[0] or 0, r[2:])
    want = sorted(((i, bool(learn), *b) for (i, _, learn), b in zip(rows, brute(rows, weight), strict=True)), key=key)
    got = sorted(map(tuple, got), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-12) and abs(g[6] - w[6]) <= STEP / 2 * w[2] + 1e-9


@pytest.mark.parametrize(("n", "bound"), [(0, 5), (1, 0), (1, 2**64 - 1), (300, 40), (5000, 2**40), (70_000, 10**6), (3000, 2**64 - 1)])
def test_sequence(n, bound):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, bound, n, np.uint64, endpoint=True))
    sequence = EliasFano(EliasFano.encode(values, bound))
    assert (sequence[np.arange(n)] == values).all()
    asked = np.concatenate([values, rng.integers(0, bound, 500, np.uint64, endpoint=True), np.array([0, bound], np.uint64)])
    at = sequence.find(asked)
    there = np.isin(asked, values)
    assert ((at >= 0) == there).all() and (n == 0 or (values[at[there]] == asked[there]).all())
    if n:
        first = np.minimum(np.arange(n) + 1, n)
        later = sequence.find(values, first, np.full(n, n))
        assert ((later >= first) | (later == -1)).all() and (later[:-1] >= 0).tolist() == (values[1:] == values[:-1]).tolist()


def test_sequence_is_compact():
    values = np.sort(np.random.default_rng(1).integers(0, 2**40, 100_000, np.uint64))
    assert 8 * len(EliasFano.encode(values, 2**40)) / 100_000 < 2 + math.log2(2**40 / 100_000) + 0.1


def test_trie_from_a_mapped_file(tmp_path):
    rng = np.random.default_rng(2)
    context, word, count = rng.integers(0, 2**64, 40, np.uint64)[rng.integers(0, 40, 3000)], rng.integers(0, 300, 3000).astype(np.uint64) << np.uint64(20), rng.integers(1, 9, 3000)
    far = {int(context[0]): 10**9}
    path = tmp_path / "trie"
    path.write_bytes(Trie.build(context, word, count, far, 10.0))
    with path.open("rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as mapped:
        trie = Trie(mapped)
        two, one = Counter(), Counter()
        for h, w, n in zip(context.tolist(), word.tolist(), count.tolist(), strict=True):
            two[h, w] += n
            one[h] += n
        one.update({h: n - one[h] for h, n in far.items()})
        asked = [(h, w) for h in [*one, 5] for w in range(0, 301 << 20, 1 << 20)]
        at, counts, back = trie.context(np.array([h for h, _ in asked], np.uint64))
        codes = trie.successor(at, np.array([w for _, w in asked], np.uint64))
        for (h, w), n, b, code in zip(asked, counts.tolist(), back.tolist(), codes.tolist(), strict=True):
            assert n == one.get(h, 0) and (code == NONE) == ((h, w) not in two)
            assert abs(b * STEP + math.log10(10 / (n + 10))) <= STEP / 2 + 1e-9
            if code != NONE:
                assert abs(code * STEP + math.log10(two[h, w] / (n + 10))) <= STEP / 2 + 1e-9
        del trie, at, counts, back, codes


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, learning boolean, block int, hash string")


def test_against_dictionaries(spark):
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(60)] + ["Émile", "ÀB", "日本"]
    texts = [" ".join(rng.choice(names, rng.integers(0, 80))) for _ in range(120)]
    texts += ["the " * 500, "THE the\tThe\x0bthe the\r\nthe", "", None, " \n", "long " + "of the " * 60_000, texts[0], texts[0]]
    rows = [(i, t, i % 4 != 1) for i, t in enumerate(texts)]
    rows += [(7, texts[7], True), (7, "another text of seven", False), (None, "the unknown", True), (None, "the unknown", True)]
    df = frame(spark, rows)
    compare(scored(df, F.col("learning")).collect(), rows)
    # Many blocks and shards: hot contexts are dealt over several of them.
    compare(scored(df, F.col("learning"), 7.0, block_tokens=600, shard_tokens=9000).collect(), rows, 7.0)
    nothing = [(i, t, False) for i, t, _ in rows]
    compare(scored(frame(spark, nothing), F.col("learning")).collect(), nothing)
    assert scored(df.limit(0), F.col("learning")).count() == 0
    shards = tries(df, F.col("learning"), shard_tokens=9000).collect()
    learnt = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t, learn in rows if learn]
    assert len(shards) > 3 and sum(Trie(r.trie).successors.n for r in shards) == len({p for c in learnt for p in zip(["\n", *c], c, strict=False)})


def test_held_out_texts_are_likelier_than_by_single_words(spark, sf):
    rows = op11(spark, sf).filter("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert rows[2] / rows[0] > rows[1] / rows[0] + 0.1
