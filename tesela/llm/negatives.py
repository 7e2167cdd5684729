"""Hard negatives by inner product from k-means inverted lists with stored centroid radii.

Every row lies in the list of its nearest centroid, and a list stores the largest distance of its rows from it.  By Cauchy
and Schwarz no row of a list scores above anchor.centroid + |anchor| * radius nor below the same with a minus.  An
anchor visits lists by that upper bound, skips those outside its windows of scores, and stops when the bound
falls strictly below its kth score, so that results are exact, ties included.

Lists are dealt into shards of a bounded number of rows (a hot list into many), anchors into sheets; a shard and a sheet
meet in one cogrouped task.  Each anchor first meets the shard of its best list alone; the kth score found there holds in all
others, and shards without a list that could better it are never met.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, checkpointed, table

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_ROW = "dim int, cluster int, vec_id long, label long, vec binary, distance double"


class Lists(NamedTuple):
    """What is known of the lists of vectors of one length: one entry a list, as many as there are centroids."""

    centroids: np.ndarray
    radius: np.ndarray
    shard: np.ndarray  # the first of its shards
    shards: np.ndarray  # how many it fills

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest and lowest score of each anchor with a row of each list; a little more than rounding may cost."""
        middle = anchors @ self.centroids.T
        spread = np.linalg.norm(anchors, axis=1)[:, None] * self.radius
        spread = spread + (np.abs(middle) + spread) * 1e-9 + np.linalg.norm(anchors, axis=1)[:, None] * np.linalg.norm(self.centroids, axis=1) * 1e-9 + 1e-6
        return middle + spread, middle - spread


def packed(values: np.ndarray) -> list[bytes]:
    """Each row of a matrix of integers as bytes: two for each component where that holds all of the matrix, else eight."""
    small = not values.size or (values.min() >= -(1 << 15) and values.max() < 1 << 15)
    return [row.tobytes() for row in values.astype("<i2" if small else "<i8")]


def _unpacked(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    rows = [np.frombuffer(x, "<i2" if len(x) == 2 * dim else "<i8") for x in column.to_pylist()]
    return np.stack(rows).astype(np.int64) if rows else np.zeros((0, dim), np.int64)


def kmeans(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from rows spread evenly over the sample; an emptied centroid takes the farthest row."""
    distinct = np.unique(sample, axis=0)
    distinct = distinct[np.random.default_rng(12).permutation(len(distinct))]
    centroids = distinct[: max(1, min(clusters, len(distinct)))].astype(float)
    for _ in range(rounds):
        distance = (centroids**2).sum(axis=1) - 2 * sample @ centroids.T
        near = distance.argmin(axis=1)
        far = np.argsort(-(distance.min(axis=1) + (sample**2).sum(axis=1)))
        count = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        centroids = total / np.maximum(count, 1)[:, None]
        empty = np.flatnonzero(count == 0)[: len(far)]
        centroids[empty] = sample[far[: len(empty)]]
    return centroids


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v (array of floor(scale * x)) and dim, once a vec_id, of the rows that take part."""
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter("vec_id is not null and label is not null and e is not null").filter(~bad)
    rows = rows.select("vec_id", F.struct(F.transform("e", lambda x: F.floor(x * float(scale))).alias("v"), "label").alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v", F.size("row.v").alias("dim"))


def _assigned(rows: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """The rows with their nearest centroid and the distance from it; a length that no sampled row had has one at zero."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                v = some.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(some.num_rows, dim)
                c, x = centroids.get(int(dim), np.zeros((1, dim))), v.astype(float)
                near = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
                distance = np.linalg.norm(x - c[near], axis=1)
                arrays = [some.column("dim"), pa.array(near.astype(np.int32)), some.column("vec_id"), some.column("label"), pa.array(packed(v), pa.binary()), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(arrays, ["dim", "cluster", "vec_id", "label", "vec", "distance"])

    return rows.mapInArrow(nearest, _ROW)


def layout(sizes: list[tuple[int, int, int, float]], centroids: dict[int, np.ndarray], shard_rows: int) -> dict[int, Lists]:
    """Lists by length of vector, from (dim, cluster, rows, radius): small lists share a shard, a large one has several."""
    out: dict[int, Lists] = {}
    at, room = -1, 0
    for dim, cluster, rows, radius in sorted(sizes):
        if dim not in out:
            c = centroids.get(dim, np.zeros((1, dim)))
            out[dim] = Lists(c, np.full(len(c), -1.0), np.zeros(len(c), np.int64), np.zeros(len(c), np.int64))
            room = 0
        need = -(-rows // shard_rows)
        if need > 1 or rows > room:
            first, at, room = at + 1, at + need, shard_rows - rows if need == 1 else 0
        else:
            first, room = at, room - rows
        out[dim].radius[cluster], out[dim].shard[cluster], out[dim].shards[cluster] = radius, first, need
    return out


def best(lists: Lists, anchor: int, label: int, vector: np.ndarray, slots: list[list[int]], ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, span: dict[int, tuple[int, int]], same: bool, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Per slot (number, lowest, highest and least useful score): its number, ids and scores of its k best, and rows read.

    ``span`` gives, by list, the rows of ``matrix`` that it holds.  Matrix and vector are floats, or integer objects
    where floats would round.
    """
    here = np.array(sorted(span))
    high, low = lists.bounds(vector.astype(float)[None, :])
    high, low = high[0][here], low[0][here]
    kth = [s[3] for s in slots]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in slots]
    read = 0
    for j in np.argsort(-high, kind="stable"):
        if all(high[j] < max(kth[s], slots[s][1]) for s in range(len(slots))):
            break
        live = [s for s in range(len(slots)) if high[j] >= max(kth[s], slots[s][1]) and low[j] <= slots[s][2]]
        if not live:
            continue
        a, b = span[here[j]]
        scores = matrix[a:b] @ vector
        scores = scores.astype(np.int64) if scores.dtype != object else np.array([min(max(int(x), _LEAST), _MOST) for x in scores], np.int64)
        read += b - a
        open_ = ((labels[a:b] == label) == same) & (ids[a:b] != anchor)
        for s in live:
            pick = open_ & (scores >= max(slots[s][1], kth[s])) & (scores <= slots[s][2])
            if not pick.any():
                continue
            names, values = np.concatenate([found[s][0], ids[a:b][pick]]), np.concatenate([found[s][1], scores[pick]])
            order = np.lexsort((names, ~values))[:k]  # ~ turns the order round and can't overflow
            found[s] = names[order], values[order]
            if len(order) == k:
                kth[s] = max(kth[s], int(found[s][1][-1]))
    for s, (names, values) in zip(slots, found, strict=True):
        yield s[0], names, values, read


_FOUND = "anchor_id long, slot int, vec_id long, score long"


def _meet(routed: DataFrame, rows: DataFrame, index: dict[int, Lists], sheets: int, same: bool, k: int) -> DataFrame:
    """anchor_id, slot, vec_id, score: the k best of each slot in each shard that its anchor was sent to."""
    schema = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(members: pa.Table, asked: pa.Table) -> pa.Table:
        if not members.num_rows or not asked.num_rows:
            return schema.empty_table()
        members = members.sort_by([("cluster", "ascending"), ("vec_id", "ascending")])
        dim = members["dim"][0].as_py()
        exact, anchors = _unpacked(members["vec"], dim), _unpacked(asked["vec"], dim)
        largest = max((float(np.abs(m.astype(float)).max()) if m.size else 0.0) for m in (exact, anchors))
        kind = float if largest * largest * max(1, dim) < 2.0**52 else object
        exact, anchors = exact.astype(kind), anchors.astype(kind)
        clusters, ids, labels = (members[c].to_numpy() for c in ("cluster", "vec_id", "label"))
        starts = np.flatnonzero(np.r_[True, clusters[1:] != clusters[:-1]])
        span = {int(clusters[a]): (int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(clusters)], strict=True)}
        out: list[list[np.ndarray]] = [[], [], [], []]
        for anchor, label, slots, vector in zip(asked["anchor_id"].to_pylist(), asked["label"].to_pylist(), asked["slots"].to_pylist(), anchors, strict=True):
            for slot, names, values, _ in best(index[dim], anchor, label, vector, slots, ids, labels, exact, span, same, k):
                for column, part in zip(out, (np.full(len(names), anchor), np.full(len(names), slot), names, values), strict=True):
                    column.append(part)
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)).cast(f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    dealt = rows.withColumn("sheet", F.explode(F.sequence(F.lit(0), F.lit(sheets - 1)))).groupBy("shard", "sheet")
    return dealt.cogroup(routed.groupBy("shard", "sheet")).applyInArrow(meet, _FOUND)


def _routed(asked: DataFrame, index: dict[int, Lists], sheets: int, first: bool) -> DataFrame:
    """The anchors once for each shard they have to meet: that of their best list, or all others that may matter."""
    schema = "anchor_id long, label long, dim int, vec binary, slots array<array<long>>, shard array<long>"

    def shards(slots: list[list[int]], high: np.ndarray, low: np.ndarray, lists: Lists) -> list[int]:
        full = lists.shards > 0
        met = np.flatnonzero(full & np.any([(high >= s[1]) & (low <= s[2]) for s in slots], axis=0)) if slots else np.zeros(0, int)
        if not len(met):
            return []
        home = int(lists.shard[met[np.argmax(high[met])]])
        if first:
            return [home]
        useful = np.any([(high >= max(s[1], s[3])) & (low <= s[2]) for s in slots], axis=0)
        return sorted({int(x) for c in met[useful[met]] for x in range(lists.shard[c], lists.shard[c] + lists.shards[c])} - {home})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                high, low = index[int(dim)].bounds(_unpacked(some.column("vec"), int(dim)).astype(float))
                to = [shards(s, h, w, index[int(dim)]) for s, h, w in zip(some.column("slots").to_pylist(), high, low, strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(to, pa.list_(pa.int64()))], ["anchor_id", "label", "dim", "vec", "slots", "shard"])

    routed = asked.select("anchor_id", "label", "dim", "vec", "slots").mapInArrow(route, schema).withColumn("shard", F.explode("shard"))
    return routed.withColumn("sheet", F.pmod(F.xxhash64("anchor_id"), F.lit(sheets)).cast("int"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each slot, ``rank`` from 1; Spark keeps the k best of each task before it shuffles."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(asked: DataFrame, rows: DataFrame, index: dict[int, Lists], sheets: int, same: bool, k: int) -> DataFrame:
    """anchor_id, slot, vec_id, score, rank for anchors with ``slots`` of [number, lowest score, highest score]."""
    slots = F.transform("slots", lambda s: F.concat(s, F.array(F.lit(_LEAST))))
    seeds = checkpointed(_meet(_routed(asked.withColumn("slots", slots), index, sheets, True), rows, index, sheets, same, k))
    kth = _ranked(seeds, k).filter(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("long"), "score"))).alias("kth"))
    least = F.transform("slots", lambda s: F.concat(s, F.array(F.coalesce(F.try_element_at("kth", s[0]), F.lit(_LEAST)))))
    rest = _meet(_routed(asked.join(kth, "anchor_id", "left").withColumn("slots", least), index, sheets, False), rows, index, sheets, same, k)
    return _ranked(seeds.union(rest), k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 3, high: int = 9, scale: int = 256, clusters: int = 256, sample: int = 8192, shard_rows: int = 8192, sheet_rows: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vectors`` (vec_id, embedding, label) have their components x turned into floor(scale * x); ``is_anchor`` is a condition
    on vec_id and label.  An anchor's positives are the first ``positives`` other rows of its label by inner product, ties by
    smaller vec_id; for each of them its first ``negatives`` rows of other labels follow, of those that score from
    ``low`` to ``high`` tenths of the positive.  Fewer come back where there are fewer; a positive without any has no row.

    Rows whose label, vector, any component or vec_id is null, or with a component that isn't finite, take no part.  Rows
    that share a vec_id count once, with the smallest of their vectors, then labels.  Vectors of different lengths don't
    meet; empty ones score 0 with one another.  Scores beyond the range of a long are held at its ends.  Other columns
    are ignored whatever their names; an empty table gives an empty result.

    Centroids, at most ``clusters``, are fitted on at most ``sample`` rows, all rows are in the lists, and the choice of
    centroids changes only what is read.  A task holds one shard and one sheet: raise both at scale, since rows are
    sent once for each sheet and anchors once for each shard that may better their scores.
    """
    whole = usable(vectors, scale)
    taken: dict[int, list[list[int]]] = {}
    for r in bounded_sample(whole, "vec_id", sample).select("dim", "v").collect():
        taken.setdefault(r.dim, []).append(r.v)
    centroids = {dim: kmeans(np.array(v, float).reshape(len(v), dim), clusters) for dim, v in taken.items()}
    assigned = checkpointed(_assigned(whole, centroids))
    sizes = assigned.groupBy("dim", "cluster").agg(F.count("*").alias("rows"), F.max("distance").alias("radius"))
    index = layout([tuple(r) for r in sizes.collect()], centroids, shard_rows)
    places = [(int(d), c, int(x.shard[c]), int(x.shards[c])) for d, x in index.items() for c in range(len(x.radius)) if x.shards[c]]
    spark = vectors.sparkSession
    place = spark.createDataFrame(places, "dim int, cluster int, first long, parts long")  # one row a list
    rows = assigned.join(F.broadcast(place), ["dim", "cluster"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    rows = rows.select("shard", "dim", "cluster", "vec_id", "label", "vec")

    anchors = assigned.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "dim", "vec")
    sheets = max(1, -(-anchors.count() // sheet_rows))
    every = F.array(F.array(F.lit(0).cast("long"), F.lit(_LEAST), F.lit(_MOST)))
    near = checkpointed(_search(anchors.withColumn("slots", every), rows, index, sheets, True, positives).select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Tenths of a long without overflow: score = 10 q + r.
    q, r = F.expr("positive_score div 10"), F.expr("positive_score % 10")
    lowest, highest = low * q + F.ceil(low * r / 10), high * q + F.floor(high * r / 10)
    windows = near.select("anchor_id", F.array(F.col("slot").cast("long"), lowest, highest).alias("window")).filter(F.col("window")[1] <= F.col("window")[2])
    windows = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_list("window")).alias("slots"))
    found = _search(anchors.join(windows, "anchor_id"), rows, index, sheets, False, negatives)
    out = found.join(near, ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5
), negatives AS (
    SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
    FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
