"""Embedding near-duplicates: an exact metric range join.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other. Pivots cut the space into cells by the nearest
pivot. A vector x of home cell h can have a partner in cell c only if its distance to the bisector of the two pivots,
(d(x,c)^2 - d(x,h)^2) / (2 d(c,h)), is at most r (by the triangle inequality, never weaker than d(x,c) - d(x,h) <= 2r): it is
then copied into c. A pair of two cells is looked for in the lower one only, so a vector is copied to lower cells only.
Cells join independently, in blocks, by products whose result double precision decides. Pivots are vectors of a bounded
sample that lie far apart, as many as leave the sample's vectors copied COPIES times at most; they change the work, never the
result. Where vectors point evenly in all directions, distances to any pivot are nearly equal: no number of pivots separates
them, few cells remain, and the blocks compare nearly all pairs (figures in the README).

Equal vectors are one class before the join. A block gives for each of its vectors the number of linked vectors, and one edge
to the smallest of its component inside the block; distributed union-find joins these.

Defined cases: null vectors, zero vectors and those with null, NaN or infinite components link with nothing; vectors of
different lengths never link; rows with one vec_id are told apart by their vectors; a null vec_id counts as a link of others
but is nobody's component_id while its component has another id; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, forest, ship, stored, table, temporary

SAMPLE, PIVOTS, COPIES, BLOCK, STRIP = 4_096, 1_024, 4.0, 8_192, 512
#: Products in single precision are off by less than this for unit vectors of up to some thousand components.
MARGIN = 1e-3


def units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    # components of extreme size would overflow when squared
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, valid, node (hash of the vector), check (another), dim, raw (doubles), for each row."""
    ship(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1):
                v = v.as_py()
                x = np.asarray([np.nan if c is None else c for c in v], "<f8") if v else np.zeros(0)
                valid = bool(len(x)) and bool(np.isfinite(x).all()) and bool(x.any())
                raw = (x + 0.0).tobytes() if valid else b""
                h = xxhash.xxh3_128_intdigest(raw)
                out.append((valid, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), len(x), raw))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True))], ["vec_id", "valid", "node", "check", "dim", "raw"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, valid boolean, node long, check long, dim int, raw binary")


def copies(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and a mask of the lower cells that it is copied to."""
    far = np.maximum(2 - 2 * (x @ pivots.T), 0)
    home = far.argmin(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 1e-12))[home]
    gap = (far - far[np.arange(len(x)), home][:, None]) / (2 * apart)
    return home, (gap <= radius + 1e-9) & (np.arange(len(pivots)) < home[:, None])


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """The sample's vectors, each as far from all before it as can be: any number of them from the start are far apart."""
    near, out = np.full(len(sample), np.inf), []
    at = 0
    for _ in range(min(most, len(sample))):
        out.append(at)
        near = np.minimum(near, 2 - 2 * (sample @ sample[at]))
        at = int(near.argmax())
    return sample[out]


def choose_pivots(sample: np.ndarray, radius: float) -> np.ndarray:
    p = min(PIVOTS, max(1, len(sample) // 4))
    order = spread(sample, p)
    while p > 1 and copies(sample, order[:p], radius)[1].sum(axis=1).mean() > COPIES:
        p //= 2
    return order[:p]


def block_links(x: np.ndarray, y: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked vectors; for a block with itself, each pair once.

    A strip of rows at a time bounds the memory; single precision finds the pairs that double precision then decides."""
    p, q = x.astype(np.float32), y.astype(np.float32).T
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(x), STRIP):
        # of a block with itself nothing left of the diagonal counts
        first = k if same else 0
        s, t = np.nonzero(p[k : k + STRIP] @ q[:, first:] >= least - MARGIN)
        s, t = s + k, t + first
        if same:
            s, t = s[s < t], t[s < t]
        for m in range(0, len(s), 1 << 16):
            i, j = s[m : m + (1 << 16)], t[m : m + (1 << 16)]
            sure = np.einsum("ij,ij->i", x[i], y[j]) >= least
            left.append(i[sure])
            right.append(j[sure])
    return np.concatenate(left), np.concatenate(right)


def cosine_links(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept for each row."""
    with temporary(vectors.sparkSession) as keep:
        rows, named = (keep(x) for x in linked_classes(vectors, least))
    out = rows.join(named, ["node", "check"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def linked_classes(vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The rows with their classes, and the classes (node, check) with n_links and component_id, both stored."""
    spark, radius = vectors.sparkSession, float(np.sqrt(2 - 2 * least))
    rows = stored(classes_of(vectors), "vectors")
    groups = rows.where("valid").groupBy("node", "check").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"), F.min("dim").alias("dim"), F.min("raw").alias("raw"))
    groups = stored(groups, "classes")
    sample: dict[int, list[bytes]] = {}
    for dim, raw in groups.orderBy("node").limit(SAMPLE).select("dim", "raw").collect():
        sample.setdefault(dim, []).append(raw)
    pivots = spark.sparkContext.broadcast({d: choose_pivots(units(r), radius) for d, r in sample.items()})

    def deal(batches):
        for batch in batches:
            rows_ = batch.to_pydict()
            dims = np.asarray(rows_["dim"])
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                x = units([rows_["raw"][i] for i in at])
                p = pivots.value.get(int(d), x[:1] * 0 + np.eye(1, int(d)))
                home, mask = copies(x, p, radius)
                which, cell = np.nonzero(mask)
                index = np.concatenate([at, at[which]])
                cells = np.concatenate([home, cell])
                at_home = np.concatenate([np.ones(len(at), bool), np.zeros(len(which), bool)])
                yield pa.RecordBatch.from_arrays([pa.array([rows_["node"][i] for i in index], pa.int64()), pa.array([rows_["copies"][i] for i in index], pa.int64()), pa.array([int(d)] * len(index), pa.int32()), pa.array(cells, pa.int32()), pa.array(at_home), pa.array([rows_["raw"][i] for i in index], pa.binary())], ["node", "copies", "dim", "cell", "home", "raw"])

    dealt = stored(groups.select("node", "copies", "dim", "raw").mapInArrow(deal, "node long, copies long, dim int, cell int, home boolean, raw binary"), "cells")
    # at most PIVOTS rows for each length of vectors
    counts = dealt.groupBy("dim", "cell").agg(F.count_if("home").alias("n"), F.count_if(~F.col("home")).alias("m"))
    blocks = counts.select("dim", "cell", F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int").alias("hb"), F.greatest(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int").alias("rb"))
    placed = dealt.join(F.broadcast(blocks), ["dim", "cell"])
    own = F.pmod(F.xxhash64("node"), F.col("hb")).cast("int")
    other = F.pmod(F.xxhash64("node"), F.col("rb")).cast("int")
    # a task (i, j): home block i against home block j >= i, or against copied block j (numbered from hb)
    with_home = F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    with_copies = F.transform(F.sequence(F.lit(0), F.col("rb") - 1), lambda k: F.struct(own.alias("i"), (k + F.col("hb")).alias("j")))
    copied = F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda k: F.struct(k.alias("i"), (other + F.col("hb")).alias("j")))
    tasks = placed.withColumn("task", F.explode(F.when(F.col("home"), F.concat(with_home, with_copies)).otherwise(copied)))
    tasks = tasks.select("dim", "cell", "task.i", "task.j", F.when(F.col("home"), own).otherwise(other + F.col("hb")).alias("block"), "node", "copies", "raw")

    def join(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        _, _, i, j = (k.as_py() for k in key)
        part = part.sort_by("node")
        block, node, weight = (np.asarray(part.column(c)) for c in ("block", "node", "copies"))
        a, b = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        if not len(a) or not len(b):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "low": pa.array([], pa.int64())})
        x = units(part.column("raw").to_pylist())
        s, t = block_links(x[a], x[b], i == j, least)
        s, t = a[s], b[t]
        links = np.bincount(s, weight[t], len(node)) + np.bincount(t, weight[s], len(node))
        low, met = node[forest(len(node), s, t)], links > 0
        return pa.table({"node": node[met], "links": links[met].astype(np.int64), "low": low[met]})

    found = stored(tasks.groupBy("dim", "cell", "i", "j").applyInArrow(join, "node long, links long, low long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.where("node != low").select("node", "low"))
    named = groups.select("node", "check", "copies", "vec_id").join(links, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named, "named")
    least_id = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = stored(named.join(least_id, "component").select("node", "check", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "linked")
    return rows, named


def op8_vector_join(spark, sf_dir: str) -> DataFrame:
    return cosine_links(table(spark, sf_dir, "embeddings"))
