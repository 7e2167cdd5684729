"""Mixture-controlled packing of token streams into fixed windows.

Source queues are served by deficit round-robin (Shreedhar and Varghese, 1996).  In every round a queue earns a
quantum, its target share of one window, and sends a piece as soon as its deficit covers it; what it can't spend it
carries into the next round.  Documents are cut at the multiples of their queue's quantum, so a queue sends its piece
``b`` in round ``b``, and the whole schedule follows from running sums: rounds are a formula, not a loop, and deficits
carry over windows and partitions by construction.  A queue whose quantum is tiny saves up for pieces of a useful length
and begins with a deficit of its own, so that such queues don't all send at once.  Laying the rounds end to end and
cutting every window's worth of tokens gives sequences whose proportions stay within one piece a queue of the targets.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: The pre-tokenizer's public pattern for byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here the classes of characters are the same in every Unicode version.
_STABLE = 0x250
#: A running sum has a block for so many rows, but no more blocks than this, since block totals are summed in one place.
BLOCK_ROWS, MOST_BLOCKS = 256, 1 << 16
#: Up to so many sources their quanta are broadcast (under 10 MB), beyond it they are joined.
MOST_BROADCAST = 100_000


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts by a byte-level BPE tokenizer file, as arrays of unsigned 32-bit numbers.

    Where ids are merge ranks, tiktoken's loop gives the tokenizer's ids about four times as fast on the file's own
    vocabulary.  Texts with characters whose class could differ between the two libraries' Unicode versions, and all
    texts of other tokenizers, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.odd = re.compile(f"[^\x00-{chr(_STABLE - 1)}]").search
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte, special = _byte_of(), {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        ordered = all(model["model"]["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges))
        alike = ordered and model.get("normalizer") is None and (model.get("pre_tokenizer") or {}) | {"trim_offsets": True} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy if alike else None

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast(text, disallowed_special=())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _packed(ids: np.ndarray) -> bytes:
    """Ids compressed by byte planes, since high bytes vary little."""
    return pa.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def blocks(rows: Column) -> Column:
    return F.least(F.greatest(F.ceil(rows / BLOCK_ROWS), F.lit(1)), F.lit(MOST_BLOCKS)).cast("long")


def running_total(df: DataFrame, by: list[str], order: list[Column], block: Column, value: str, name: str, block_name: str = "block") -> DataFrame:
    """``df`` with, in ``name``, the sum of ``value`` over earlier rows of its group in the order (block, order...).

    No group goes to one task: rows are summed inside blocks, block totals are few and are summed across blocks, and
    each row adds its block's start to the sum inside its block.
    """
    df = df.withColumn(block_name, block)
    inside = Window.partitionBy(*by, block_name).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, block_name).agg(F.sum(value).alias("_total"))
    across = Window.partitionBy(*by).orderBy(block_name) if by else Window.orderBy(block_name)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    keys = [*by, block_name]
    out = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [out[k].eqNullSafe(starts[k]) for k in keys]
    out = out.join(starts, same).drop(*[starts[k] for k in keys])
    return out.withColumn(name, F.col("_inside") + F.col("_start")).drop("_inside", "_start", block_name)


def summed_in_order(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with, in ``name``, the sum of ``value`` (long) over all earlier rows in the order of the columns ``order``.

    Rows are dealt by ranges of the order, which are sampled and so of even size whatever its distribution; sums run
    inside a range, and the ranges' totals, one row a partition, are summed across.
    """
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column(columns.index(value)).to_numpy()
            ends = total + np.cumsum(size)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - size), pa.array(np.full(len(size), part, np.int64))], [*columns, "_inside", "_part"])

    shape = rows.withColumn("_inside", F.lit(0).cast("long")).withColumn("_part", F.lit(0).cast("long")).schema
    # Written down, since the number of a range is only good for the run that dealt it.
    dealt = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, shape))
    totals = dealt.groupBy("_part").agg(F.max(F.col("_inside") + F.col(value)).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_inside") + F.col("_start")).select(*columns, name)


def quanta(queues: DataFrame, window: int, piece: int, targets: dict[str, float] | None, temper: float) -> DataFrame:
    """queue, blocks, stride (tokens of a piece), phase (of the first), ratio and lag (rounds between pieces, before the first)."""
    weight = F.pow(F.col("tokens").cast("double"), F.lit(float(temper)))
    total = queues.agg(F.sum(weight)).first()[0] or 1.0
    share = weight / total
    if targets:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.col("source")].cast("double"), share)
    out = queues.select(F.col("source").alias("queue"), F.greatest(share * window, F.lit(1e-9)).alias("quantum"), blocks(F.col("docs")).alias("blocks"))
    out = out.withColumn("stride", F.greatest("quantum", F.lit(float(piece))))
    draw = F.pmod(F.xxhash64("queue", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    out = out.withColumn("phase", F.when(F.col("stride") > F.col("quantum"), draw * F.col("stride")).otherwise(0.0))
    return out.select("queue", "blocks", "stride", "phase", (F.col("stride") / F.col("quantum")).alias("ratio"), (F.col("phase") / F.col("quantum")).alias("lag"))


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, targets: dict[str, float] | None = None, temper: float = 1.0, piece: int = 64, encode: Callable[[str], np.ndarray] | None = None) -> DataFrame:
    """One row for each piece of a document of ``docs`` (doc_id, text, source) in a sequence of ``window`` tokens.

    Columns: doc_id, source, start, length, ids (bytes, little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset.  A document is its token ids and then ``end_id``; a null text is an empty one, so it is ``end_id`` alone.
    Every sequence is full but the last of all, which is the only one that needs padding.

    ``targets`` gives each source's share of a window; sources that it leaves out, and all where it is None, get a share
    in proportion to ``tokens ** temper``, so with a ``temper`` of 1 every queue lasts to the end.  Otherwise a queue may
    run dry early, and the rest then go on in their own proportions; a source with a target of 0 comes after all others.
    A queue whose share of a window is under ``piece`` tokens sends ``piece`` at once, every so many rounds.

    A null source is a queue of its own.  A repeated row is packed as often as it occurs; different texts of one doc_id
    are packed each.  Rows without doc_id are packed too and come back with a null doc_id.  Texts of any length are
    packed whole, ties are broken by hashes of the rows, other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = encode or encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [np.append(get(t.as_py() or ""), end_id).astype("<u4") for t in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(x) for x in ids], pa.int64()), pa.array(map(_packed, ids), pa.binary())], ["doc_id", "source", "key", "n", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                held, n = part.column(2), part.column(3).to_numpy()
                flat = held.flatten()
                start, length, at = (flat.field(c).to_numpy() for c in ("start", "length", "at"))
                row = np.repeat(np.arange(len(n)), np.diff(held.offsets.to_numpy()))
                order = np.lexsort((start, row))
                start, length, at, row = start[order], length[order], at[order], row[order]
                # Pieces over a window's border become one a window.
                parts = (at + length - 1) // window - at // window + 1
                which = np.repeat(np.arange(len(at)), parts)
                k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
                lo_ = np.maximum(at[which], (at[which] // window + k) * window)
                hi_ = np.minimum((at + length)[which], (at[which] // window + k + 1) * window)
                row, start, length = row[which], start[which] + lo_ - at[which], hi_ - lo_
                # In the order of their starts a document's pieces tile it, so the ids' bytes stay where they are.
                ids = np.concatenate([_unpacked(p, m) for p, m in zip(part.column(4).to_pylist(), n.tolist(), strict=True)] or [np.zeros(0, "<u4")])
                cuts = pa.array(4 * np.concatenate([[0], np.cumsum(length)]), pa.int64())
                data = pa.Array.from_buffers(pa.large_binary(), len(row), [None, cuts.buffers()[1], pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                rows = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(start), pa.array(length), data, pa.array(n[row]), pa.array(lo_ // window), pa.array(lo_ % window)], names)

    # Rows are named by doc_id and a hash of all they hold, the same whenever it is computed; rows alike in both are copies.
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", "source", "text").alias("key"), F.col("text").cast("string").alias("text"))
    # Tokenising is the dear part: it happens once, and the ids wait compressed in a written table.
    tokens = checkpointed(flat.mapInArrow(encoded, "doc_id long, source string, key long, n long, packed binary"))
    counted = tokens.drop("packed")
    entries = counted.groupBy("doc_id", "source", "key").agg(F.min("n").alias("n"), F.count("*").alias("copies"))
    entries = entries.select("doc_id", "source", "key", "n", "copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))

    queues = checkpointed(counted.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")))
    quota = quanta(queues, window, piece, targets, temper)
    # Sources may be hosts: their quanta are broadcast only while there are few.
    quota = F.broadcast(quota) if queues.count() <= MOST_BROADCAST else quota.hint("merge")
    rows = entries.join(quota, F.col("source").eqNullSafe(F.col("queue"))).drop("queue")
    order = [F.xxhash64("doc_id", "key", "copy"), F.col("doc_id"), F.col("key"), F.col("copy")]
    rows = running_total(rows, ["source"], order, F.pmod(F.xxhash64("doc_id", "key", "copy", F.lit(1)), F.col("blocks")), "n", "before")

    # Piece b of a queue ends at phase + b * stride, and its deficit covers that in round lag + b * ratio.
    # The slivers keep whole numbers whole; whatever rounding does, a document's pieces meet at the same borders.
    turn = lambda at: (F.floor((at - F.col("phase")) / F.col("stride") + 1e-9) + 1).cast("long")
    border = lambda b: F.ceil(F.col("phase") + b * F.col("stride") - 1e-6).cast("long")
    end = F.col("before") + F.col("n")
    rows = rows.withColumn("first", turn(F.col("before"))).withColumn("last", turn(end - 1)).withColumn("b", F.explode(F.sequence("first", "last")))
    starts = F.when(F.col("b") == F.col("first"), F.col("before")).otherwise(F.greatest("before", F.least(border(F.col("b") - 1), end)))
    ends = F.when(F.col("b") == F.col("last"), end).otherwise(F.greatest("before", F.least(border(F.col("b")), end)))
    pieces = rows.select("doc_id", "key", "copy", "copies", F.ceil(F.col("lag") + F.col("b") * F.col("ratio")).cast("double").alias("round"), F.xxhash64("source").alias("queue"), starts.alias("place"), (ends - starts).alias("length"), (starts - F.col("before")).alias("start"))
    pieces = summed_in_order(pieces.filter("length > 0"), ["round", "queue", "place", "doc_id", "key", "copy"], "length", "at")

    name = lambda: [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("name"), "key"]
    # A document's pieces are bounded by its own tokens.
    placed = checkpointed(pieces.groupBy(*name(), "copy").agg(F.min("copies").alias("copies"), F.collect_list(F.struct("start", "length", "at")).alias("pieces")))
    named = tokens.select("doc_id", "source", "n", "packed", *name())
    # The hint keeps the plan the same at every size: the ids are never the side to broadcast, nor the places.
    ready = named.join(placed.filter("copies = 1").hint("merge"), ["name", "key"]).select("doc_id", "source", "pieces", "n", "packed")
    copied = placed.filter("copies > 1")
    if not copied.isEmpty():
        some = named.join(copied.select("name", "key").distinct().hint("merge"), ["name", "key"], "left_semi").dropDuplicates(["name", "key"])
        ready = ready.union(some.join(copied.hint("merge"), ["name", "key"]).select("doc_id", "source", "pieces", "n", "packed"))
    return ready.mapInArrow(cut, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens; sources' targets go with the power 0.7 of their tokens, which
    lifts small ones, as is usual for training mixtures.
    """
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), temper=0.7)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
