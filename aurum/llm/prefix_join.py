"""N-gram Jaccard join: an exact set-similarity self-join by grouped prefixes.

A document's set holds the hashes (64 bits) of its distinct word shingles. Documents with equal sets are one class.
Classes whose prefix and size agree are one group: the join runs over groups, filters pairs of groups by size and place,
and only then expands them to members and verifies those against the whole sets.

Order of tokens: any one order of all tokens gives a right prefix filter. Here tokens that many prefixes share (HOT_TOKENS
of them at most, whatever the data: the threshold rises until they fit) come last, the rest by hash. So a passage that
thousands of documents share is seldom in a prefix.

What is asked for is components, so a pair that already hangs together needs no check. Pairs are checked in rounds: the
members of a group against its first member and the groups of a token against its first group; then, for tokens and groups
whose members are still in several components, a second star around another member; last, every remaining pair between
components. The last round makes the result exact, the stars before it keep it small. Before its sets are fetched a pair
must pass an exact bound: two parity sketches, of about a bit for each element, differ in no more bits than the sets
differ in elements. Tokens that only one class has are dropped from the prefixes, those that a Bloom filter of fixed size
lets through by a join.

Defined cases: a text without words has an empty set and links with nothing; a null text is an empty one; rows with one
doc_id are told apart by their sets, and rows that repeat one are alike; an empty table gives an empty one; a row with null doc_id links with nothing and has a null component; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Words, components, discard, lists_of, ship, stored, table, temporary, worker_cache

HOT_TOKENS, HOT_FROM, BLOOM = 1_000_000, 8, 1 << 24
#: Longs of the folded sketch that the last join compares, and words that are hashed at a time.
FOLD, CHUNK = 16, 200_000
#: Bits of the least and of the largest parity sketch.
LEAST_BITS, MOST_BITS = 64, 1 << 16
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def word_hashes() -> Words:
    return worker_cache("prefix_join", lambda: Words(xxhash.xxh64_intdigest))


def sorted_set(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def shingle_sets(texts, size: int):
    """For each text (an Arrow string) the sorted hashes of its distinct shingles of `size` (at most 8) words; of fewer words,
    the whole sequence is one. Many texts are hashed side by side."""
    held, counts = [], []
    for text in texts:
        words = text.as_py().encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII blanks only
        held += words
        counts.append(len(words))
        if len(held) >= CHUNK:
            yield from _hashed(held, counts, size)
            held, counts = [], []
    yield from _hashed(held, counts, size)


def _mixed(h: np.ndarray, starts: int, size: int) -> np.ndarray:
    out = np.full(starts, size, np.uint64)
    for i in range(size):
        out ^= h[i : starts + i] * MIX[i]
        out *= MIX[7]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _hashed(words: list[bytes], counts: list[int], size: int):
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    every = _mixed(h, max(0, len(h) - size + 1), size)
    at = 0
    for n in counts:
        yield sorted_set(every[at : at + n - size + 1] if n >= size else _mixed(h[at : at + n], 1, n) if n else np.zeros(0, np.int64))
        at += n


def shingles(text: str, size: int) -> np.ndarray:
    return next(shingle_sets([pa.scalar(text)], size))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def signed(digest: int) -> tuple[int, int]:
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def texts_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def prefix_tokens(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(token) of the prefixes by hash alone."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(0), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[: prefix_length(len(s), percent)] for s in sets if len(s)] or [np.zeros(0, np.int64)]), pa.int64())], ["token"])

    return texts_of(docs.where("doc_id is not null")).select("text").mapInArrow(run, "token long")


def sketches(docs: DataFrame, size: int, percent: int, hot: np.ndarray) -> DataFrame:
    """doc_id, n, f1, f2 (together the set's identity), g1, g2 (of size and prefix), bits (parity sketch), fold (one of FOLD longs), prefix."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        last = shared.value
        for batch in batches:
            numbers, bits, folds, prefixes = [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                n = len(s)
                identity = signed(xxhash.xxh3_128_intdigest(s.tobytes()))
                m = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, n - 1).bit_length()))
                bits.append(np.packbits((np.bincount(s & (m - 1), minlength=m) & 1).astype(np.uint8), bitorder="little").view("<i8"))
                folds.append(bits[-1] if m == FOLD * 64 else np.packbits((np.bincount(s & (FOLD * 64 - 1), minlength=FOLD * 64) & 1).astype(np.uint8), bitorder="little").view("<i8"))
                if n and len(last):
                    common = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                    s = np.concatenate([s[~common], s[common]])
                prefixes.append(s[: prefix_length(n, percent)] if n else s)
                numbers.append((n, *identity, *signed(xxhash.xxh3_128_intdigest(prefixes[-1].tobytes(), n))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)), lists_of(bits, pa.int64()), lists_of(folds, pa.int64()), lists_of(prefixes, pa.int64())], ["doc_id", "text_hash", "n", "f1", "f2", "g1", "g2", "bits", "fold", "prefix"]) if numbers else batch.slice(0, 0)

    return texts_of(docs).mapInArrow(run, "doc_id long, text_hash long, n long, f1 long, f2 long, g1 long, g2 long, bits array<long>, fold array<long>, prefix array<long>")


def bloom_bits(column: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(column), F.lit(BLOOM)), F.pmod(F.xxhash64(column, F.lit(1)), F.lit(BLOOM))]


def bloom_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of longs: BLOOM bits, so of one size for any number of ids."""
    bit = ids.select(F.explode(F.array(*bloom_bits(F.col(ids.columns[0])))).alias("bit"))
    marks = bit.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    out = np.zeros(BLOOM // 64, np.int64)
    for word, bits in marks.collect():  # at most BLOOM / 64 rows
        out[word] = bits
    return out.view(np.uint8)


def passes(marks: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (marks[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def sets_of(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """(node, set) of the classes in wanted (node, f1, f2, doc_id). A Bloom filter of the doc_ids keeps the others' sets from
    being shuffled; which set is a class's own is told by its identity."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted.select("doc_id")))

    def run(batches):
        marks = shared.value
        for batch in batches:
            keep = passes(marks, np.asarray(batch.column(1))) & passes(marks, np.asarray(batch.column(2)))
            sets = list(shingle_sets(batch.filter(pa.array(keep)).column(0), size))
            ids = [signed(xxhash.xxh3_128_intdigest(s.tobytes())) for s in sets]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (zip(*ids, strict=True) if ids else ((), ()))), lists_of(sets, pa.int64())], ["f1", "f2", "set"])

    rows = texts_of(docs.where("doc_id is not null"))
    rows = rows.select("text", *[b.alias(f"b{k}") for k, b in enumerate(bloom_bits(F.col("doc_id")))])
    return rows.mapInArrow(run, "f1 long, f2 long, set array<long>").join(wanted.select("node", "f1", "f2"), ["f1", "f2"]).select("node", "set").dropDuplicates(["node"])


def with_shared_tokens(rows: DataFrame) -> DataFrame:
    """rows with prefix replaced by tokens: (pos, token) of those prefix tokens that several sets have, nearly."""
    tokens = rows.where("doc_id is not null").select("f1", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi"))
    shared = rows.sparkSession.sparkContext.broadcast(bloom_of(tokens.where("lo < hi").select("token")))
    bits = [F.transform("prefix", lambda t: bloom_bits(t)[0]).alias("b0"), F.transform("prefix", lambda t: bloom_bits(t)[1]).alias("b1")]

    def run(batches):
        marks = shared.value
        for batch in batches:
            at, flat = np.asarray(batch.column("prefix").offsets), np.asarray(batch.column("prefix").flatten())
            at = at - at[0]
            keep = np.ones(len(flat), bool)
            for c in ("b0", "b1"):
                keep &= passes(marks, np.asarray(batch.column(c).flatten()))
            pos = np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at))
            cuts = np.concatenate([[0], np.cumsum(keep)])[at]
            new = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x[keep], pa.int64())) for x in (pos, flat)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + new, [*names, "pos", "token"])

    names = [c for c in rows.columns if c != "prefix"]
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "prefix")
    return rows.select(*names, "prefix", *bits).mapInArrow(run, f"{kinds}, pos array<bigint>, token array<bigint>")


def similar(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * inter >= percent * (a + b - inter)


def may_link(percent: int) -> Column:
    """Size filter and parity bound on pairs with n_a, n_b, bits_a, bits_b."""
    a, b = F.col("n_a"), F.col("n_b")

    def folded(bits: str, other: str) -> Column:
        """A sketch of twice the bits holds the smaller one: its halves differ by the elements of either."""
        half = (F.size(bits) / 2).cast("int")
        return F.when(F.size(bits) > F.size(other), F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(bits))

    differ = F.aggregate(F.zip_with(folded("bits_a", "bits_b"), folded("bits_b", "bits_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    # the symmetric difference has at least `differ` elements, so the intersection has at most (a + b - differ) / 2
    return (percent * F.greatest(a, b) <= 100 * F.least(a, b)) & similar(F.floor((a + b - differ) / 2), a, b, percent)


def folds_allow(percent: int) -> Column:
    """The parity bound on pairs with n_a, n_b and the longs of their folded sketches, p0 .. and q0 .."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(FOLD)])
    a, b = F.col("n_a"), F.col("n_b")
    return similar(F.floor((a + b - differ) / 2), a, b, percent)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """pairs (a, b) of nodes -> stored pairs (a, b) that link; None if there are no pairs to check."""
    narrow = classes.select("node", "n", "bits")
    ready = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ready = ready.join(narrow.toDF("a", "n_a", "bits_a"), "a").join(narrow.toDF("b", "n_b", "bits_b"), "b")
    ready = stored(ready.where(may_link(percent)).select("a", "b").distinct(), "pairs")
    if not ready.take(1):
        return None
    nodes = ready.select(F.col("a").alias("node")).union(ready.select("b")).distinct()
    wanted = stored(classes.select("node", "f1", "f2", "doc_id").join(nodes, "node", "left_semi"), "nodes")
    sets = stored(sets_of(docs, size, wanted), "sets")
    met = ready.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.asarray(x.values), np.asarray(y.values)
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    out = stored(met.mapInArrow(run, "a long, b long"), "linked")
    for x in (ready, wanted, sets):
        discard(x)
    return out


def hot_tokens(tokens: DataFrame) -> np.ndarray:
    """The tokens of most documents: at most HOT_TOKENS of them."""
    counts = tokens.groupBy("token").count().where(F.col("count") >= HOT_FROM)
    counts = stored(counts, "hot")
    level = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("level")).count().collect()
    least, total = HOT_FROM, 0
    for row in sorted(level, reverse=True):
        total += row["count"]
        if total > HOT_TOKENS:
            least = 2 ** (row["level"] + 1)
            break
    out = np.sort(np.fromiter((r[0] for r in counts.where(F.col("count") >= least).select("token").toLocalIterator()), np.int64))
    discard(counts)
    return out


def linked_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id for each row."""
    return linked_rows(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def linked_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows (doc_id, text_hash) with n, the size of the set, component_id and component, a number of the component of its
    own: where rows repeat doc_ids, two components can have one smallest doc_id. It is null for empty sets."""
    with temporary(docs.sparkSession) as keep:
        rows, named = (keep(x) for x in named_sets(docs, size, percent))
    return rows.join(named, ["f1", "f2"], "left").select("doc_id", "text_hash", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "component")


def named_sets(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, f1, f2) of each row, and (f1, f2, component_id, component) of each class of sets; both stored."""
    rows = stored(sketches(docs, size, percent, hot_tokens(prefix_tokens(docs, size, percent))), "sketches")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("least"))
    # a class's number is its node: unique, whatever the doc_ids are, and fixed once it is written
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    full = with_shared_tokens(rows).join(classes, ["f1", "f2"]).where("doc_id = least").select("node", "doc_id", "f1", "f2", "n", "g1", "g2", "bits", "fold", "pos", "token").dropDuplicates(["node"])
    full = stored(full, "full")
    # groups: one row for each prefix and size, named by its smallest node
    groups = full.groupBy("g1", "g2", "n").agg(F.min("node").alias("gid"), F.count("*").alias("members"))
    members = stored(full.select("node", "n", "g1", "g2").join(groups, ["g1", "g2", "n"]).select("node", "n", "gid", "members"), "members")
    heads = full.join(groups.select(F.col("gid").alias("node"), "n", "members"), ["node", "n"])
    span = F.floor(F.log("n") / -np.log(percent / 100)).cast("int")  # linked sizes are in one band or in neighbouring bands
    lists = heads.select(F.col("node").alias("gid"), "n", "members", span.alias("band"), F.explode(F.arrays_zip("pos", "token")).alias("at")).select("gid", "n", "members", "band", "at.pos", "at.token")
    shared = lists.groupBy("token").agg(F.sum("members").alias("k")).where("k > 1").select("token")
    lists = stored(lists.drop("members").join(shared, "token", "left_semi"), "lists")

    stars = members.where("members > 1").select(F.col("node").alias("a"), F.col("gid").alias("b"))
    centre = lists.groupBy("token", "band").agg(F.min("gid").alias("b"))
    stars = stars.union(lists.join(centre, ["token", "band"]).select(F.col("gid").alias("a"), "b"))
    found = [x for x in [verified(stars, full, docs, size, percent)] if x is not None]

    def state() -> DataFrame:
        """members with their components so far."""
        if not found:
            return members.withColumn("comp", F.col("node"))
        comp = components(reduce(DataFrame.union, found)).withColumnRenamed("component", "comp")
        return stored(members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "state")

    for last in (False, True):
        now = state()
        parts = now.groupBy("gid", "n", "comp").agg(F.min_by("node", F.xxhash64("node")).alias("node"))
        each = lists.join(parts.select("gid", "n", "comp", "node"), ["gid", "n"])
        several = each.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
        if not last:
            each = stored(each.join(several, "token", "left_semi"), "open")
            centre = each.groupBy("token").agg(F.min_by("node", F.xxhash64("node", "token")).alias("b"), F.min_by("comp", F.xxhash64("node", "token")).alias("comp_b"))
            pairs = each.join(centre, "token").where("comp != comp_b").select(F.col("node").alias("a"), "b")
            inner = parts.groupBy("gid").agg(F.min("node").alias("b"), F.count("*").alias("k")).where("k > 1")
            pairs = pairs.union(parts.join(inner, "gid").select(F.col("node").alias("a"), "b"))
        else:
            # the groups of tokens that are still open, expanded to their members; a pair leaves the join only if its
            # components, sizes, places and sketches allow a link
            open_ = lists.join(several, "token", "left_semi").join(now.select("gid", "n", "comp", "node"), ["gid", "n"])
            folds = [F.get("fold", k).alias(f"k{k}") for k in range(FOLD)]
            each = stored(open_.join(full.select("node", "n", *folds), ["node", "n"]).select("token", "pos", "node", "n", "comp", *[f"k{k}" for k in range(FOLD)]), "open")
            left = each.toDF("token", "pos_a", "a", "n_a", "c", *[f"p{k}" for k in range(FOLD)])
            right = each.toDF("token", "pos_b", "b", "n_b", "d", *[f"q{k}" for k in range(FOLD)])
            need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent) - 1e-9)
            most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) + F.least("pos_a", "pos_b")
            met = left.join(right, (left["token"] == right["token"]) & (F.col("c") < F.col("d")) & (percent * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")) & (most >= need) & folds_allow(percent))
            pairs = met.select("a", "b").distinct()
        got = verified(pairs, full, docs, size, percent)
        discard(each)
        if got is not None:
            found.append(got)
    comp = state().select("node", "comp").groupBy("node").agg(F.min("comp").alias("comp"))
    named = classes.join(comp, "node")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = stored(named.join(least, "comp").select("f1", "f2", "component_id", F.col("comp").alias("component")), "named")
    return stored(rows.select("doc_id", "text_hash", "n", "f1", "f2"), "rows"), named


def op10_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))
