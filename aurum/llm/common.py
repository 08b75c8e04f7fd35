"""Shared parts of the training-data operators: shared-folder tables, row keys, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes, about, that an operator may keep in a Python worker.
CACHE_BYTES = 160 << 20
#: A stored table of at most so many short rows may be broadcast, and one of at most so many rows and items of its list
#: column together: 40 MB at the most. Larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_ITEMS = 200_000, 1_000_000
#: Links that one task may join up.
LOCAL_LINKS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, wherever the driver imported it from."""
    if (app := spark.sparkContext.applicationId) not in _shipped:
        root = Path(__file__).resolve().parent.parent
        file = Path(tempfile.mkdtemp(prefix="aurum-")) / "aurum.zip"
        with zipfile.ZipFile(file, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(file))
        _shipped.add(app)


_held: dict = {}


def worker_cache(name, make):
    """What an operator keeps in a Python worker between tasks: one operator's cache at a time, so that a worker that runs
    several operators in turn holds one budget (CACHE_BYTES, about) and not the sum of them."""
    if name not in _held:
        if _held:
            _held.clear()
            gc.collect()
            try:  # give the memory back to the system, where the C library can
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass
        _held[name] = make()
    return _held[name]


class Words(dict):
    """A cache word -> value(word) of CACHE_BYTES at most, about; long words are not kept. It has two generations: when the
    young one is full it becomes the old one, and what is used again comes back from there."""

    def __init__(self, value):
        self.value, self.most, self.old = value, CACHE_BYTES // 256 // 2, {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.value(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = self.copy()
                self.clear()
            self[word] = found
        return found


def lists_of(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays) if len(arrays) else [], kind))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets a
    temporary one; a cluster's executors would each write to a disk of their own, so there it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="aurum-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/aurum-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


_scopes: list[set[str]] = []


@contextmanager
def temporary(spark: SparkSession):
    """What stored() writes inside is deleted at the end, but for the tables that were given to the function yielded: those
    pass to the scope around, if there is one."""
    mine: set[str] = set()
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.__dict__["_aurum_path"])
        return df

    _scopes.append(mine)
    try:
        yield keep
    finally:
        _scopes.remove(mine)
        if _scopes:
            _scopes[-1].update(kept)
        for path in mine - kept:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if _scopes:
        _scopes[-1].add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._aurum_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that stored() wrote, once nothing needs it."""
    if path := df.__dict__.get("_aurum_path"):
        delete(df.sparkSession, path)


def small(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """Marks a stored table of narrow rows for broadcasting if it is within the bound; weight: the items of a row."""
    n, most = (df.count(), BROADCAST_ROWS) if weight is None else (df.agg(F.sum(weight + 1)).first()[0] or 0, BROADCAST_ITEMS)
    if n > most:
        return df
    out = F.broadcast(df)
    out._aurum_path = df.__dict__.get("_aurum_path")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each vertex's component."""
    low = np.arange(n)
    while True:
        new = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        # the ends' own labels, too, so that whole components move at once
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def components_here(batches):
    """Arrow batches of links (u, v) -> (node, component), for a list of links that one task can hold."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    links = pa.Table.from_batches(held).combine_chunks()
    kind, names = links.schema.field("u").type, None
    sides = []
    for c in ("u", "v"):
        column = links.column(c).combine_chunks()
        if pa.types.is_struct(kind):
            names = [f.name for f in kind]
            sides.append([np.asarray(x) for x in column.flatten()])
        else:
            sides.append([np.asarray(column)])
    fields = [np.concatenate(x) for x in zip(*sides, strict=True)]
    order = np.lexsort(fields[::-1])
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([f[order][1:] != f[order][:-1] for f in fields], axis=0)
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(fresh) - 1
    nodes = [f[order][fresh] for f in fields]
    half = len(code) // 2
    low = forest(len(nodes[0]), code[:half], code[half:])

    def column(values: list[np.ndarray]) -> pa.Array:
        arrays = [pa.array(x) for x in values]
        return pa.StructArray.from_arrays(arrays, names) if names else arrays[0]

    yield pa.RecordBatch.from_arrays([column(nodes), column([x[low] for x in nodes])], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find by alternating large-star and small-star rounds.

    edges: two columns of longs (or of structs of longs), in any order, repeats and self-links allowed. Returns (node,
    component), component being the smallest node reachable; only nodes with a link to another node appear. Every round is
    written to the shared folder, so that a lost executor costs one round at most and plans stay short. A list of at most
    LOCAL_LINKS links, some 30 MB, is one task's work instead; the result is the same."""
    a, b = (F.col(c) for c in edges.columns)
    links = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    if links.count() <= LOCAL_LINKS:
        ship(edges.sparkSession)
        kind = links.schema["u"].dataType.simpleString()
        out = stored(links.coalesce(1).mapInArrow(components_here, f"node {kind}, component {kind}"), "components")
        discard(links)
        return out
    seen = None
    while True:
        mark = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            out = links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            out._aurum_path = links._aurum_path
            return out
        seen = mark
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        after = stored(small, "links")
        discard(links)
        links = after
