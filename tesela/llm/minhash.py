"""Near-duplicate documents by b-bit MinHash (Li and Koenig, 2010).

1. Each text becomes its set of hashed word shingles.  Equal sets (exact copies and their like) collapse to one
   representative first, so a group of copies of any size costs one row from here on.
2. A representative has ``bands * rows`` minima; bands of whole minima give bucket keys.  One more hash deals the
   shingles to ``LANES`` lanes (one-permutation MinHash), and of each lane's minimum only the lowest bit is kept; two
   bits in a long tell empty, 0 and 1 apart, so that counting common bits compares two documents.
3. Candidates come from buckets, without all pairs of a bucket: every member is paired with the bucket's hub, the
   member that meets most others over all its buckets.  The packed signatures give a similarity, corrected for lanes
   that agree by chance; pairs surely below the threshold go without reading texts.
4. The rest is confirmed on full shingle sets, and confirmed links give components.
5. Where members of a bucket still lie in different components, every pair of them across components that the
   signatures don't rule out is confirmed too.  No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, utf8
from .textkit import LOWER, Words, slices, windows

#: Lanes of the packed signature, each of two bits, and the longs they fill.
LANES = 768
LONGS = LANES * 2 // 64
#: A pair is ruled out when its estimate is so many standard deviations below the threshold.
SURE = 4.0
#: Members of a bucket that are compared with one another in one place.
BLOCK = 256
#: Shingles whose minima are taken at once.
_CHUNK = 1 << 14


def _sets(data: np.ndarray, bounds: np.ndarray, width: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their bounds."""
    words = Words(data, bounds)
    hashes = words.hashes(LOWER if lower else None)
    count = np.diff(words.first)
    runs = windows(hashes, width)
    at = np.arange(len(runs))
    whole = words.doc[at] == words.doc[at + width - 1] if len(runs) else np.zeros(0, bool)
    doc, value = words.doc[at[whole]], runs[whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = [windows(hashes[words.first[i] : words.first[i + 1]], count[i])[0] ^ np.uint64(count[i]) for i in short]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, np.array(extra, np.uint64)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(bounds)))


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(20_240_229).integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _minima(value: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The minimum of each seeded function over each nonempty set; one row a set."""
    with np.errstate(over="ignore"):
        out = np.full((len(bounds) - 1, len(seeds)), 0xFFFFFFFF, np.uint32)
        a, b = (value & np.uint64(0xFFFFFFFF)).astype(np.uint32), (value >> np.uint64(32)).astype(np.uint32)
        full = np.flatnonzero(np.diff(bounds))
        i = 0
        while i < len(full):  # sets are taken together up to a chunk, longer ones in pieces
            lo = bounds[full[i]]
            j = max(i + 1, int(np.searchsorted(bounds[full], lo + _CHUNK, "left")))
            j = min(j, len(full))
            hi = bounds[full[j - 1] + 1]
            if hi - lo <= 4 * _CHUNK:
                cuts = bounds[full[i:j]] - lo
                x, y = a[lo:hi], b[lo:hi]
                for k, s in enumerate(seeds):
                    out[full[i:j], k] = np.minimum.reduceat(x * s + y, cuts)
            else:
                for p in range(lo, hi, _CHUNK):
                    x, y = a[p : min(p + _CHUNK, hi)], b[p : min(p + _CHUNK, hi)]
                    for k, s in enumerate(seeds):
                        out[full[i], k] = min(out[full[i], k], (x * s + y).min())
            i = j
        return out


def _packed(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One bit of each lane's minimum as two bits of a long (01 for 0, 10 for 1, 00 for an empty lane); one row a set.

    Lanes are ranges of the hash, so in a sorted set each lane's minimum is the first of its run.
    """
    out = np.zeros((len(bounds) - 1, LONGS), np.uint64)
    if not len(value):
        return out
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    lane = ((value >> np.uint64(32)) * np.uint64(LANES) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(value), bool)
    first[1:] = (lane[1:] != lane[:-1]) | (doc[1:] != doc[:-1])
    value, lane, doc = value[first], lane[first], doc[first]
    bit = np.uint64(1) << (np.uint64(2) * (lane % 32).astype(np.uint64) + (value & np.uint64(1)))
    cell = doc * LONGS + lane // 32
    new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    out.reshape(-1)[cell[new]] = np.bitwise_or.reduceat(bit, new)
    return out


def signatures(docs: DataFrame, bands: int, rows: int, width: int, lower: bool) -> DataFrame:
    """doc_id, n_shingles, set_hi and set_lo (128 bits that name the set), keys (one long a band), s0... (the packed lanes)."""
    seeds = _seeds(bands * rows)
    names = ["doc_id", "n_shingles", "set_hi", "set_lo", "keys", *(f"s{i}" for i in range(LONGS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            salt = np.random.default_rng(7).integers(0, 1 << 62, (2, rows, bands), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            for batch in batches:
                for lo, hi, data, bounds in slices(batch.column(1)):
                    value, cut = _sets(data, bounds, width, lower)
                    size = np.diff(cut)
                    total = np.zeros((2, len(value) + 1), np.uint64)
                    np.cumsum(value, out=total[0, 1:])
                    np.cumsum((value ^ (value >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) ^ (value >> np.uint64(32)), out=total[1, 1:])
                    name = total[:, cut[1:]] - total[:, cut[:-1]]
                    minima = _minima(value, cut, seeds)
                    blocks = minima.reshape(hi - lo, bands, rows).astype(np.uint64)
                    keys = np.zeros((hi - lo, bands), np.uint64)
                    for r in range(rows):
                        keys = (keys ^ blocks[:, :, r] * salt[0, r]) * salt[1, r]
                        keys ^= keys >> np.uint64(31)
                    packed = _packed(value, cut).view(np.int64)
                    wide = lambda m, t: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel().view(t)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(name[0].view(np.int64)), pa.array(name[1].view(np.int64)), wide(keys, np.int64), *(pa.array(np.ascontiguousarray(c)) for c in packed.T)], names
                    )

    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_hi long, set_lo long, keys array<long>, " + ", ".join(f"s{i} long" for i in range(LONGS)))


def filled_lanes(prefix: str = "s") -> Column:
    return sum((F.bit_count(f"{prefix}{i}") for i in range(1, LONGS)), F.bit_count(f"{prefix}0"))


def common_bits(a: str, b: str) -> Column:
    """Bits that the lanes ``{a}0...`` and ``{b}0...`` of two documents share."""
    return sum((F.bit_count(F.col(f"{a}{i}").bitwiseAND(F.col(f"{b}{i}"))) for i in range(1, LONGS)), F.bit_count(F.col(f"{a}0").bitwiseAND(F.col(f"{b}0"))))


def needed_bits(a: str, b: str, similarity: float, sure: float = SURE) -> Column:
    """How many common bits two documents of that similarity have, less ``sure`` standard deviations.

    From ``f_{side}`` (filled lanes) and ``n_{side}`` (set size).  Common bits are the lanes with one minimum and, by
    chance, half of those that both fill with different ones; the expectation corrects for these.
    """
    lanes = F.col(f"f_{a}").cast("double") + F.col(f"f_{b}")
    half = lanes / 2.0
    part = similarity / (1.0 + similarity)
    # Lanes both fill with different minima, from lanes of about equal number.
    clash = (half - lanes * part) * (half - lanes * part) / (F.lit(LANES + 1.0) - lanes * part)
    same = (lanes - clash) * part
    # Lanes sample the union without replacement: what they hold of it needs no guess.
    unseen = F.greatest(F.lit(0.03), 1.0 - lanes / (F.col(f"n_{a}") + F.col(f"n_{b}")))
    variance = similarity * (1.0 - similarity) * unseen * (lanes - same) + clash * 0.25 + 1.0
    return same + clash / 2.0 - sure * F.sqrt(variance)


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: float, width: int, lower: bool) -> DataFrame:
    """Of pairs (a, b) of ids in ``texts`` (id, text) those whose full sets have a similarity of ``threshold`` hundredths or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keep = batch.num_rows, []
            step = 64
            for lo in range(0, rows, step):
                part = batch.slice(lo, step)
                sides = []
                for c in (2, 3):
                    got: list[np.ndarray] = []
                    for _, _, data, bounds in slices(part.column(c)):
                        value, cut = _sets(data, bounds, width, lower)
                        got += np.split(value, cut[1:-1])
                    sides.append(got)
                for x, y in zip(*sides, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
        .select("a", "b", "ta", "tb")
        .mapInArrow(run, "a long, b long")
    )


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node in ``links`` (a, b).

    Each round a node takes the smallest label next to it and then its label's label, so long chains take a number of
    rounds logarithmic in their length.  Labels live in checkpointed tables; only the count of changes comes back.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("node").alias("of"), F.col("component").alias("up"))
        after = checkpointed(lower.join(jump, F.col("component") == F.col("of"), "left").select("node", "old", F.least("component", F.coalesce("up", "component")).alias("component")))
        discard(labels)
        labels = after
        if labels.filter("old <> component").isEmpty():
            discard(both)
            return labels.select("node", "component")
        labels = after.select("node", "component")
        labels.written_to = after.written_to


def near_duplicates(docs: DataFrame, threshold: float = 85, width: int = 5, lower: bool = True, bands: int = 25, rows: int = 5) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_shingles, component_id, kept, n_links.

    Two documents are linked when ``100 * |A & B| >= threshold * |A | B|`` over their sets of ``width``-word
    shingles; with fewer words the whole sequence is the one shingle.  component_id is the smallest doc_id reachable
    over links; ``kept`` says that it is the document's own; n_links counts confirmed links of the document's
    representative (links found redundant are not tried).

    With 25 bands of 5, a pair at the threshold of 85 shares no band with a probability of 4e-7, and the lanes rule
    out one just at the threshold with a probability of 3e-5; both fall steeply above it.

    Null or wordless texts have no shingles and link with nothing.  Rows without doc_id link with nothing and come
    back with a null component, kept.  A repeated row gives a repeated result.  Different texts of one doc_id are one
    document, which is linked where one of its texts is.  Texts of any length are read whole.  Other columns of ``docs``
    are ignored, whatever their names; an empty table gives an empty result.
    """
    sign = checkpointed(signatures(docs, bands, rows, width, lower))
    filled = sign.filter("n_shingles > 0 and doc_id is not null")
    sets = checkpointed(filled.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")))
    # A document that is the smallest of its set stands for it; repeated rows of it are one.
    lanes = [f"s{i}" for i in range(LONGS)]
    reps = filled.join(sets.select(F.col("rep").alias("doc_id"), "set_hi", "set_lo"), ["doc_id", "set_hi", "set_lo"]).dropDuplicates(["doc_id", "set_hi", "set_lo"])
    reps = checkpointed(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), filled_lanes().alias("f"), "keys", *lanes))

    exploded = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    crowded = exploded.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    live = checkpointed(exploded.join(crowded, "key"))
    degree = live.groupBy("rep").agg(F.sum("members").alias("degree"))
    hubs = live.join(degree, "rep").groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("r"))).alias("top")).select("key", (-F.col("top.r")).alias("hub"))
    star = live.select("key", "rep").join(hubs, "key").filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()

    side = lambda name: reps.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("f").alias(f"f_{name}"), *[F.col(c).alias(f"{name}{c[1:]}") for c in lanes])
    sized = F.lit(100) * F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b")
    probable = common_bits("a", "b") >= needed_bits("a", "b", threshold / 100)
    # Only texts that share a bucket can be needed; they are picked once, whatever the number of pairs.
    texts = checkpointed(docs.select(F.col("doc_id").cast("long").alias("id"), utf8("text").alias("text")).join(live.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi"))
    tested: list[DataFrame] = []
    links: list[DataFrame] = []

    def test(pairs: DataFrame) -> None:
        tested.append(checkpointed(pairs))
        links.append(checkpointed(confirmed(tested[-1], texts, threshold, width, lower)))

    test(star.join(side("a"), "a").join(side("b"), "b").filter(sized & probable).select("a", "b"))
    joined = components(links[0])
    now = checkpointed(live.join(joined, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("component")))
    mixed = now.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("key")
    # Short forms of the keys tell whether a pair shares an earlier band too, so that it comes out once.
    short = reps.withColumn("keys", F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")))
    # Large buckets are cut into blocks, and every block meets every other in a place of its own.
    sizes = now.join(mixed, "key").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    part = checkpointed(now.join(sizes, "key").join(short, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    facing = lambda name, own, met: part.select(F.col("key").alias(f"key_{name}"), F.col("block").alias(f"{own}_{name}"), F.col("other").alias(f"{met}_{name}"), F.col("band").alias(f"band_{name}"), F.col("keys").alias(f"keys_{name}"), F.col("rep").alias(name), F.col("component").alias(f"c_{name}"), F.col("n").alias(f"n_{name}"), F.col("f").alias(f"f_{name}"), *[F.col(c).alias(f"{name}{c[1:]}") for c in lanes])
    earliest = reduce(lambda x, y: x & y, [(F.col("band_a") <= i) | (F.col("keys_a")[i] != F.col("keys_b")[i]) for i in range(bands - 1)], F.lit(True))
    rest = facing("a", "x", "y").join(facing("b", "y", "x"), (F.col("key_a") == F.col("key_b")) & (F.col("x_a") == F.col("x_b")) & (F.col("y_a") == F.col("y_b")) & (F.col("c_a") < F.col("c_b")) & sized & probable & earliest).select("a", "b").distinct()
    done = tested[0].select("a", "b").union(tested[0].select("b", "a"))
    test(rest.join(done, ["a", "b"], "left_anti"))
    both_links, links = links, links[0].union(links[1])

    named = sets.select("set_hi", "set_lo", "rep")
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    named = named.join(components(links), F.col("rep") == F.col("node"), "left").join(both.groupBy("a").agg(F.count("*").alias("links")), F.col("rep") == F.col("a"), "left")
    named = named.select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    linked = filled.select("doc_id", "n_shingles", "set_hi", "set_lo").join(named, ["set_hi", "set_lo"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("links").alias("n_links"))
    alone = sign.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = checkpointed(linked.union(alone).select("doc_id", "n_shingles", "component_id", (F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"), "n_links"))
    for done_with in (sign, sets, reps, live, texts, now, part, *tested, *both_links):
        discard(done_with)
    return out


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
