"""Language-model scores from an Elias-Fano n-gram trie of order two, sharded by context.

The model is a bigram with Dirichlet smoothing (MacKay and Peto, 1995): p(w|h) = (c(hw) + weight * p(w)) / (c(h) + weight), with the
unigram p(w) = (c(w) + 1) / (N + V + 1).  A trie's levels are Elias-Fano sequences in one flat buffer that can be viewed
in place or mapped from a file: hashes of contexts, running counts, pointers to successors, and successors, whose numbers
are relative to their context.  Probabilities and weights of the context are quantised logarithms.

Documents are dealt into blocks.  A block asks each shard of contexts once for each of its distinct bigrams, with their
counts in training texts; the shard adds these up to its trie, looks every question up and answers in the order asked, so
that answers need no keys.  The block then counts its texts again and sums.  What is shuffled is the text twice and some
seven bytes for each distinct bigram of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fold, table, utf8
from .textkit import LOWER, Words, mix, slices

#: Stand for the end of a text and for what comes before its first word.
END, BEGIN = (int(x) for x in mix(np.array([11, 12], np.uint64)))
#: Bits of a successor's hash that tell it from its context's others.
PRINT_BITS = 40
#: Quantised logarithms count steps of 1/2048 decade; the largest code stands for "not found".
STEP = 1 / 2048
NONE = (1 << 16) - 1


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high bits as unary gaps in a bit vector.

    :meth:`encode` gives bytes; an instance views a buffer of such bytes (a mapped file, say) without copying it.
    """

    def __init__(self, buffer: bytes | memoryview | np.ndarray):
        raw = np.frombuffer(buffer, np.uint8)
        self.n, self.width, high = (int(x) for x in raw[:24].view("<u8"))
        packed = -(-self.n * self.width // 8)
        low = raw[24 : 24 + packed + 8]
        self._words = np.ndarray((packed + 1,), "<u8", buffer=low, strides=(1,))  # eight bytes from each byte on
        bits = np.unpackbits(raw[24 + packed + 8 : 24 + packed + 8 + high], bitorder="little")
        self._ones = np.flatnonzero(bits)[: self.n]
        zeros = np.flatnonzero(bits == 0)
        #: Elements before each value of the high part.
        self._starts = np.concatenate([[0], zeros - np.arange(len(zeros))])
        self.size = 24 + packed + 8 + high

    @staticmethod
    def encode(values: np.ndarray, bound: int) -> bytes:
        n = len(values)
        values = values.astype(np.uint64)
        width = min(56, max(0, (max(1, bound) // max(1, n)).bit_length() - 1, bound.bit_length() - 24 if n < 1 << 10 else 0))
        low = b"".join(
            np.packbits(np.unpackbits(values[i : i + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)[:, :width], bitorder="little").tobytes() for i in range(0, n, 1 << 16)
        )
        high = (values >> np.uint64(width)).astype(np.int64)
        marks = np.zeros(n + (bound >> width) + 2, np.uint8)
        marks[high + np.arange(n)] = 1
        bits = np.packbits(marks, bitorder="little").tobytes()
        return np.array([n, width, len(bits)], "<u8").tobytes() + low + bytes(8) + bits

    def _low(self, at: np.ndarray) -> np.ndarray:
        place = at * self.width
        return (self._words[place >> 3] >> (place & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ((self._ones[at] - at).astype(np.uint64) << np.uint64(self.width)) | self._low(at)

    def find(self, values: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> np.ndarray:
        """The place of each value, between its ``first`` and ``last`` (exclusive) if given; -1 where there is none."""
        values = values.astype(np.uint64)
        bucket = np.minimum(values >> np.uint64(self.width), np.uint64(len(self._starts) - 2)).astype(np.int64)
        low = np.maximum(self._starts[bucket], first)
        end = self._starts[bucket + 1]
        high = end if last is None else np.minimum(end, last)
        sought = values & np.uint64((1 << self.width) - 1)
        stop = high
        left = np.flatnonzero(low < high)
        low, high = low.copy(), high.copy()
        while len(left):
            middle = (low[left] + high[left]) >> 1
            less = self._low(middle) < sought[left]
            low[left[less]] = middle[less] + 1
            high[left[~less]] = middle[~less]
            left = left[low[left] < high[left]]
        out = np.full(len(values), -1, np.int64)
        there = np.flatnonzero(low < stop)
        out[there] = np.where(self[low[there]] == values[there], low[there], -1)
        return out


class Trie:
    """Contexts and their successors.  Level one: hashes, running counts, pointers; level two: successors and codes."""

    LEVELS = ("contexts", "counts", "pointers", "words", "successors")

    def __init__(self, buffer: bytes | memoryview):
        view, at = memoryview(buffer), 0
        for name in self.LEVELS:
            level = EliasFano(view[at:])
            setattr(self, name, level)
            at += level.size
        n, m = self.contexts.n, self.successors.n
        self.back = np.frombuffer(view[at : at + 2 * n], "<u2")
        self.leaf = np.frombuffer(view[at + 2 * n : at + 2 * n + 2 * m], "<u2")

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, count: np.ndarray, totals: dict[int, int], weight: float) -> bytes:
        """The bytes of a trie; a bigram may come in parts.  ``totals``: counts of contexts that are in other shards too."""
        contexts, c = np.unique(context, return_inverse=True)
        words, w = np.unique(word, return_inverse=True)
        pair, inverse = np.unique(c.astype(np.int64) * max(1, len(words)) + w, return_inverse=True)
        n = np.bincount(inverse, weights=count, minlength=len(pair))
        owner = pair // max(1, len(words))
        total = np.bincount(owner, weights=n, minlength=len(contexts))
        for h, t in totals.items():
            at = np.searchsorted(contexts, np.uint64(h))
            if at < len(contexts) and contexts[at] == h:
                total[at] = t
        running = np.concatenate([[0], np.cumsum(total.astype(np.int64))])
        pointers = np.searchsorted(owner, np.arange(len(contexts) + 1))
        levels = [(contexts, (1 << 64) - 1), (running, int(running[-1])), (pointers, len(pair)), (words, 1 << PRINT_BITS), (pair, len(contexts) * max(1, len(words)))]
        code = lambda p: np.minimum(np.rint(-np.log10(p) / STEP), NONE - 1).astype("<u2")
        return b"".join(EliasFano.encode(v, bound) for v, bound in levels) + code(weight / (total + weight)).tobytes() + code(n / (total[owner] + weight)).tobytes()

    def context(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place (-1: none), count and code of the weight of each context; an unknown one counts 0 and has code 0."""
        at = self.contexts.find(hashes)
        known = at >= 0
        count, back = np.zeros(len(at), np.int64), np.zeros(len(at), "<u2")
        here = at[known]
        count[known] = (self.counts[here + 1] - self.counts[here]).astype(np.int64)
        back[known] = self.back[here]
        return at, count, back

    def successor(self, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each word behind the context at each place, NONE where it is not among its successors."""
        out = np.full(len(at), NONE, "<u2")
        number = self.words.find(word)
        some = np.flatnonzero((at >= 0) & (number >= 0))
        if len(some):
            h = at[some]
            found = self.successors.find(h * self.words.n + number[some], self.pointers[h].astype(np.int64), self.pointers[h + 1].astype(np.int64))
            out[some[found >= 0]] = self.leaf[found[found >= 0]]
        return out


class Known(NamedTuple):
    """What all tasks know: sums over the corpus, numbers of blocks and shards, and the hot contexts."""

    train_tokens: int
    distinct: int
    blocks: int
    shards: int
    ends: int
    #: Hash of a context that would fill a good part of a shard: its count in training and over how many shards it is dealt.
    hot: dict[int, tuple[int, int]]


def tokens(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, each text's words and then its end, and the index of each token's text."""
    parts, docs = [], []
    for lo, hi, data, bounds in slices(column):
        words = Words(data, bounds)
        parts.append(np.insert(words.hashes(LOWER), words.first[1:], np.uint64(END)))
        docs.append(np.insert(words.doc, words.first[1:], np.arange(hi - lo)) + lo)
    return (np.concatenate(parts), np.concatenate(docs)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def vocabulary(texts: DataFrame) -> DataFrame:
    """hash, learnt and everywhere: how often each token occurs in training texts and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, doc = tokens(batch.column("text"))
            learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)[doc]
            distinct, inverse = np.unique(token, return_inverse=True)
            sums = [np.bincount(inverse, minlength=len(distinct)), np.bincount(inverse[learn], minlength=len(distinct))]
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[0].astype(np.int64))], ["hash", "learnt", "everywhere"])

    return texts.select("text", "learn").mapInArrow(count, "hash long, learnt long, everywhere long").groupBy("hash").agg(F.sum("learnt").alias("learnt"), F.sum("everywhere").alias("everywhere"))


def known(vocab: DataFrame, block_tokens: int, shard_tokens: int) -> Known:
    sums = vocab.agg(F.sum("learnt"), F.count_if(F.col("learnt") > 0), F.sum("everywhere"), F.sum(F.when(F.col("hash") == F.lit(int(np.uint64(END).view(np.int64))), F.col("learnt")))).first()
    n, distinct, all_, ends = (int(x or 0) for x in sums)
    shards = max(1, -(-all_ // shard_tokens))
    limit = max(1, all_ // (4 * shards))  # fewer than 4 * shards words reach it
    hot = {int(np.int64(r.hash).view(np.uint64)): (int(r.learnt), -(-int(r.everywhere) // limit)) for r in vocab.filter(F.col("everywhere") > limit).collect()} if shards > 1 else {}
    hot.pop(END, None)  # nothing follows an end
    return Known(n, distinct, max(1, -(-all_ // block_tokens)), shards, ends, hot)


class Block:
    """The distinct bigrams of a block of texts in the order in which shards are asked; the same for the same texts."""

    def __init__(self, column: pa.ChunkedArray, what: Known):
        token, self.doc = tokens(column)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        if len(token):
            before[0] = BEGIN
        before[1:][token[:-1] == np.uint64(END)] = BEGIN
        self.words = np.unique(np.append(token, np.uint64(BEGIN)))
        self.token = np.searchsorted(self.words, token)
        pair, self.bigram = np.unique(np.searchsorted(self.words, before) * len(self.words) + self.token, return_inverse=True)
        self.context, self.word = pair // len(self.words), pair % len(self.words)
        self.prints = self.words[self.word] >> np.uint64(64 - PRINT_BITS)
        base = (mix(self.words) % np.uint64(what.shards)).astype(np.int64)
        parts = np.ones(len(self.words), np.int64)
        for h, (_, n) in what.hot.items():
            at = np.searchsorted(self.words, np.uint64(h))
            if at < len(self.words) and self.words[at] == h:
                parts[at] = n
        shard = (base[self.context] + (self.prints % parts[self.context].astype(np.uint64)).astype(np.int64)) % what.shards
        self.order = np.argsort(shard, kind="stable")
        self.shard = shard[self.order]
        self.edges = np.flatnonzero(np.r_[True, self.shard[1:] != self.shard[:-1]]) if len(shard) else np.zeros(0, np.int64)

    def questions(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Shard, the numbers of its bigrams (grouped by context) and where each context's group begins among them."""
        for a, b in zip(self.edges, [*self.edges[1:], len(self.order)], strict=True):
            some = self.order[a:b]
            context = self.context[some]
            yield int(self.shard[a]), some, np.flatnonzero(np.r_[True, context[1:] != context[:-1]])


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each value, all first bytes first: planes of equal bytes compress."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def _table(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


_ASKED = "block long, shard int, contexts binary, sizes binary, words binary, counts binary"
_ANSWER = "block long, shard int, counts binary, backs binary, leaves binary"
_KEYS, _BYTES = [pa.int64(), pa.int32()], pa.binary()


def _asked(dealt: DataFrame, what: Known) -> DataFrame:
    """One row for a block and a shard: contexts, successors of each, and how often training texts hold each bigram."""

    def ask(group: pa.Table) -> pa.Table:
        block = Block(group["text"], what)
        learn = group["learn"].to_numpy().astype(bool)[block.doc]
        counts = np.bincount(block.bigram[learn], minlength=len(block.context))
        rows, number = [], group["block"][0].as_py()
        for shard, some, starts in block.questions():
            sizes = np.diff(np.append(starts, len(some)))
            rows.append((number, shard, _planes(block.words[block.context[some[starts]]], 8), _planes(sizes, 4), _planes(block.prints[some], PRINT_BITS // 8), _planes(counts[some], 4)))
        return _table(["block", "shard", "contexts", "sizes", "words", "counts"], [*_KEYS, *[_BYTES] * 4], rows)

    return dealt.groupBy("block").applyInArrow(ask, _ASKED)


def _trie(group: pa.Table, what: Known, weight: float) -> tuple[bytes, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """The trie of a shard, and of each of its rows the contexts, successors of each, and words."""
    read = lambda name, width: [_from_planes(x, width) for x in group[name].to_pylist()]
    contexts, sizes, words, counts = read("contexts", 8), read("sizes", 4), read("words", PRINT_BITS // 8), read("counts", 4)
    parts = [np.flatnonzero(n) for n in counts]
    learnt = [np.repeat(c, s.astype(np.int64))[p] for c, s, p in zip(contexts, sizes, parts, strict=True)]
    context, word, count = (np.concatenate(x) for x in (learnt, [w[p] for w, p in zip(words, parts, strict=True)], [n[p] for n, p in zip(counts, parts, strict=True)]))
    return Trie.build(context, word, count, {h: t for h, (t, _) in what.hot.items()}, weight), contexts, sizes, words


def _answered(asked: DataFrame, what: Known, weight: float) -> DataFrame:
    def answer(group: pa.Table) -> pa.Table:
        data, contexts, sizes, words = _trie(group, what, weight)
        trie, rows = Trie(data), []
        for block, shard, c, s, w in zip(group["block"].to_pylist(), group["shard"].to_pylist(), contexts, sizes, words, strict=True):
            at, count, back = trie.context(c)
            rows.append((block, shard, _planes(count, 6), _planes(back, 2), _planes(trie.successor(np.repeat(at, s.astype(np.int64)), w), 2)))
        return _table(["block", "shard", "counts", "backs", "leaves"], [*_KEYS, *[_BYTES] * 3], rows)

    return asked.groupBy("shard").applyInArrow(answer, _ANSWER)


def _dealt(texts: DataFrame, what: Known) -> DataFrame:
    return texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(what.blocks)))


def _texts(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, text (bytes) and learn, which may be a condition on any column of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))


def tries(docs: DataFrame, learn: Column, weight: float = 100.0, block_tokens: int = 1 << 19, shard_tokens: int = 1 << 20) -> DataFrame:
    """shard and trie (the bytes that :class:`Trie` views) of the model that :func:`scored` uses."""
    texts = _texts(docs, learn)
    what = known(checkpointed(vocabulary(texts)), block_tokens, shard_tokens)

    def build(group: pa.Table) -> pa.Table:
        return _table(["shard", "trie"], [pa.int32(), _BYTES], [(group["shard"][0].as_py(), _trie(group, what, weight)[0])])

    return _asked(_dealt(texts, what), what).groupBy("shard").applyInArrow(build, "shard int, trie binary")


def scored(docs: DataFrame, learn: Column, weight: float = 100.0, block_tokens: int = 1 << 19, shard_tokens: int = 1 << 20) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text).

    Rows for which ``learn`` holds are the training texts.  Tokens are words after A-Z are lower-cased, then one end.
    base_score sums log10((c + 1) / (N + V + 1)), with a token's count c, all N and the V distinct ones in training texts;
    score sums log10 p(w|h) of the bigram; n_known counts the tokens with c > 0.

    A null text is empty: its end is its one token.  Where ``learn`` is null it doesn't hold.  Rows without doc_id are
    rows like others; repeated rows are scored and learnt from as often as they occur.  Texts of any length are read whole;
    one longer than a block makes a block of its own.  Without training texts all counts are 0.  Other columns are
    ignored whatever their names; an empty table gives an empty result.

    A block holds about ``block_tokens`` tokens, a shard the questions of about ``shard_tokens``; a task holds one of them.
    A context with more than a quarter of a shard's tokens is dealt over several shards by its successors; there are
    fewer than four such contexts a shard, and all tasks know their counts.
    """
    texts = _texts(docs, learn)
    what = known(checkpointed(vocabulary(texts)), block_tokens, shard_tokens)
    dealt = _dealt(texts, what)
    answers = _answered(_asked(dealt, what), what, weight)
    schema = pa.schema([("doc_id", pa.int64()), ("learn", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return schema.empty_table()
        block = Block(group["text"], what)
        by_shard = {s: row for s, *row in zip(*(told[c].to_pylist() for c in ("shard", "counts", "backs", "leaves")), strict=True)}
        count, back, leaf = np.zeros(len(block.words), np.int64), np.zeros(len(block.words), np.int64), np.full(len(block.context), NONE, np.int64)
        for shard, some, starts in block.questions():
            counts, backs, leaves = by_shard[shard]
            context = block.context[some[starts]]
            # A context dealt over shards is answered by each; a shard that has no learnt successor of it doesn't know it.
            count[context] = np.maximum(count[context], _from_planes(counts, 6).astype(np.int64))
            back[context] = np.maximum(back[context], _from_planes(backs, 2).astype(np.int64))
            leaf[some] = _from_planes(leaves, 2)
        end = np.searchsorted(block.words, np.uint64(END))
        count[end] = what.ends
        count[np.searchsorted(block.words, np.uint64(BEGIN))] = 0
        single = (count + 1) / (what.train_tokens + what.distinct + 1)
        pairs = np.where(leaf == NONE, 0.0, 10.0 ** (-leaf * STEP)) + 10.0 ** (-back[block.context] * STEP) * single[block.word]
        n = group.num_rows
        sums = [np.bincount(block.doc, minlength=n), np.bincount(block.doc, weights=count[block.token] > 0, minlength=n), np.bincount(block.doc, weights=np.log10(single)[block.token], minlength=n), np.bincount(block.doc, weights=np.log10(pairs)[block.bigram], minlength=n)]
        return pa.table([group["doc_id"], group["learn"], pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(np.full(n, what.train_tokens, np.int64)), pa.array(sums[2]), pa.array(sums[3])], schema=schema)

    out = "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, out)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A row without doc_id is in no fold: it is learnt from and not held out.
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    out = scored(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
