"""Fuzzy line deduplication by MinHash.

1. Lines are compared without outer blanks and lower-cased; lines under LEAST_CHARS characters are never removed. A line's
   identity is a 128-bit hash: equal lines are one.
2. Signature: RANK x BANDS minimum hashes over all shingles of SHINGLE characters, the same sets that are verified. Each
   minimum has a permutation of its own, h -> a h mod 2^32 with an odd constant a, of the shingle's mixed hash.
3. Banding: lines that agree in all hashes of a band share a bucket (99 % of pairs of similarity 0.80, more above). A
   bucket's lines are first paired with its smallest line, those of buckets that still are in several components with a line
   that a hash picks, then, across components, with each other. A pair goes on to verification if two bits of each minimum
   differ in at most DIFFER places: at similarity 0.8 a place differs with probability 0.15, so that 21 or more of 60 differ
   in about one pair of ten thousand. Pairs across components must also pass an exact bound: parity sketches of the sets of
   shingles differ in no more bits than the sets differ in elements.
4. Verification: exact Jaccard similarity, at least 0.8, of the sets of all shingles of SHINGLE characters.
5. Distributed union-find joins verified pairs; of each component the first line (by doc_id, then line number) stays.

Signing and verifying are numpy and Python over Arrow batches: in DataFrame functions alone, hashing all shingles costs more
than the budget before the first minimum (figures in the README). Everything else is DataFrame operations. The texts of
lines are never shuffled but for those of candidate pairs. Buckets with more than one in HOT of all rows, found by counting
a part of the rows, are aggregated before they are shuffled; which way a bucket goes does not change the result.

Defined cases: a null text has no lines and stays null; empty and short lines stay; a null doc_id comes first; rows with one
doc_id and different texts are told apart by the hash of the text; of rows that repeat doc_id and text one counts as the
first, and the others lose all lines that count; an empty table gives an empty one; other columns are ignored by
find_duplicates() and kept by remove_lines().
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, discard, ship, small, stored, table, temporary

LEAST_CHARS, SHINGLE, SIMILAR, RANK, BANDS, DIFFER = 20, 5, 0.8, 5, 12, 20
#: Characters that are signed at a time, lines of a batch, and the part of all rows of a table that makes a key hot.
CHUNK, LINES, HOT = 64_000, 4_096, 2_000
#: Rows of a partition whose buckets a Python worker sorts: some 50 MB.
PART_ROWS = 1 << 21
#: Longs of a parity sketch.
FOLD = 16
ODD = [int.from_bytes(hashlib.sha256(b"%d" % k).digest()[:4], "big") | 1 for k in range(RANK * BANDS)]
KEY = ["doc_key", "text_hash"]


def row_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def normal(line: str) -> str:
    return line.strip(" ").lower()


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all shingles, line after line, and where each line's begin."""
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    n = len(c) - SHINGLE + 1
    h = c[:n].copy()
    for i in range(1, SHINGLE):
        h *= np.uint32(0x9E3779B1)
        h += c[i : n + i]
    for shift, odd in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(odd)
    ends = np.cumsum(sizes)
    # those that reach over a line's end go
    h = np.delete(h, (ends[:-1, None] - np.arange(1, SHINGLE)).ravel())
    return h, np.concatenate([[0], np.cumsum(sizes - SHINGLE + 1)[:-1]])


def signatures(lines: list[str]) -> np.ndarray:
    """The minima, a row for each permutation and a column for each line."""
    h, starts = shingle_hashes(lines)
    out, moved = np.empty((RANK * BANDS, len(lines)), np.uint32), np.empty_like(h)
    for k, a in enumerate(ODD):
        np.multiply(h, np.uint32(a), out=moved)
        np.minimum.reduceat(moved, starts, out=out[k])
    return out


def banded(minima: np.ndarray) -> np.ndarray:
    """The buckets of each line, a row for each line."""
    out = np.empty((minima.shape[1], BANDS), np.int64)
    for b in range(BANDS):
        h = np.full(minima.shape[1], b + 1, np.uint64)
        for r in range(RANK):
            h = (h ^ minima[b * RANK + r]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        out[:, b] = h.view(np.int64)
    return out


def two_bits(minima: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, 31 minima to a long."""
    out = np.zeros((-(-len(minima) // 31), minima.shape[1]), np.int64)
    for k, row in enumerate(minima):
        out[k // 31] |= (row & 3).astype(np.int64) << (2 * (k % 31))
    return out


WORDS = -(-RANK * BANDS // 31)
SIGNED = "doc_key long, text_hash long, line_no int, first boolean, id long, more long, " + "".join(f"m{w} long, " for w in range(WORDS)) + "buckets array<bigint>"


def sign(docs: DataFrame) -> DataFrame:
    """A row for each line that counts: its document and number, identity (id, more), bits of its minima, buckets; stored."""
    ship(docs.sparkSession)
    names = [x.split()[0] for x in SIGNED.split(", ")]

    def run(batches):
        lines, numbers, firsts, keys, counts, held = [], [], [], [], [], 0
        minima, digests, waiting = [], [], 0

        def taken() -> int:
            """Signs what is held; how many lines wait for their batch."""
            minima.append(signatures(lines))
            digests.extend([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines])
            lines.clear()
            return len(numbers)

        def batch_of() -> pa.RecordBatch:
            all_ = np.concatenate(minima, axis=1)
            ids = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            each = np.repeat(np.asarray(keys, np.int64).reshape(-1, 2), counts, axis=0)
            columns = [each[:, 0], each[:, 1], np.asarray(numbers, np.int32), np.asarray(firsts), ids[:, 0], ids[:, 1], *two_bits(all_)]
            offsets = np.arange(0, BANDS * len(numbers) + 1, BANDS, dtype=np.int32)
            buckets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(banded(all_).ravel()))
            out = pa.RecordBatch.from_arrays([*map(pa.array, columns), buckets], names)
            for x in (numbers, firsts, keys, counts, minima, digests):
                x.clear()
            return out

        for batch in batches:
            for key, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                before, first = len(numbers), True
                for number, line in enumerate(text.as_py().split("\n")):
                    if len(line := normal(line)) >= LEAST_CHARS:
                        lines.append(line)
                        numbers.append(number)
                        firsts.append(first)
                        first = False
                        held += len(line)
                        if held >= CHUNK:
                            held = 0
                            if taken() >= LINES:
                                keys.append((key, text_hash))
                                counts.append(len(numbers) - before)
                                yield batch_of()
                                before = 0
                if len(numbers) > before:
                    keys.append((key, text_hash))
                    counts.append(len(numbers) - before)
        if lines:
            taken()
        if numbers:
            yield batch_of()

    return stored(docs.where("text is not null").select(*row_key(), "text").mapInArrow(run, SIGNED), "signed")


def may_link() -> Column:
    """Bound on the places in which the bits of two signatures, l.m0 .. and r.m0 .., differ."""
    places = F.lit(sum(1 << 2 * k for k in range(31)))
    differ = [F.col(f"l.m{w}").bitwiseXOR(F.col(f"r.m{w}")) for w in range(WORDS)]
    return reduce(Column.__add__, [F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(places)) for x in differ]) <= DIFFER


def shared(batches):
    """Arrow batches (bucket, id) of whole buckets -> (bucket, id, hub) of the buckets with several ids, each id once."""
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if not parts:
        return
    bucket, ident = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.lexsort((ident, bucket))
    bucket, ident = bucket[order], ident[order]
    fresh = np.ones(len(bucket), bool)
    fresh[1:] = (bucket[1:] != bucket[:-1]) | (ident[1:] != ident[:-1])
    bucket, ident = bucket[fresh], ident[fresh]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(bucket)))
    several = np.repeat(sizes > 1, sizes)
    yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (bucket, ident, np.repeat(ident[starts], sizes))], ["bucket", "id", "hub"])


def shared_buckets(signed: DataFrame) -> DataFrame:
    """(bucket, id, hub) of the buckets that several lines are in, stored; hub: the bucket's smallest line."""
    ship(signed.sparkSession)
    rows = signed.select(F.explode("buckets").alias("bucket"), "id")
    n = signed.count()
    least = max(32, n // (64 * HOT))
    some = signed.where(F.pmod(F.xxhash64(*KEY, "line_no"), F.lit(64)) == 0).select(F.explode("buckets").alias("bucket"))
    hot = stored(some.groupBy("bucket").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("bucket"), "hot")  # at most some BANDS x HOT rows
    parts = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * BANDS // PART_ROWS))
    cold = rows.join(F.broadcast(hot), "bucket", "left_anti").repartition(parts, "bucket")
    out = cold.mapInArrow(shared, "bucket long, id long, hub long")
    if hot.take(1):
        # each line once, before anything is shuffled
        found = stored(rows.join(F.broadcast(hot), "bucket", "left_semi").distinct(), "hot_lines")
        hubs = stored(found.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("bucket", "hub"), "hubs")
        out = out.union(found.join(F.broadcast(hubs), "bucket").select("bucket", "id", "hub"))
    return stored(out, "shared")


def shingle_codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """All shingles of all lines as numbers, equal for equal shingles and for no others; the line of each; bits of a number."""
    text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    seen = np.zeros(int(text.max()) + 1, bool)
    seen[text] = True
    bits = int(seen.sum()).bit_length()
    codes = (np.cumsum(seen) - 1)[text]
    ends = np.cumsum(sizes)
    n, outside = len(codes) - SHINGLE + 1, (ends[:-1, None] - np.arange(1, SHINGLE)).ravel()
    line = np.repeat(np.arange(len(lines)), sizes - SHINGLE + 1)
    packed, width = codes[:n].astype(np.int64), bits
    for i in range(1, SHINGLE):
        if width + bits > 62:  # too many letters for one number: what there is so far is numbered anew
            packed, width = np.unique(packed, return_inverse=True)[1], int(n).bit_length()
        packed, width = packed << bits | codes[i : n + i], width + bits
    if width > 44:  # room for the number of a line
        packed, width = np.unique(packed, return_inverse=True)[1], int(n).bit_length()
    return np.delete(packed, outside), line, width


def shared_shingles(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of lines the sizes of both sets of shingles and of what they share."""
    at = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    codes, line, bits = shingle_codes(list(at))
    each = np.sort(line << bits | codes)  # the sets, line after line
    each = each[np.append(True, each[1:] != each[:-1])]
    owner = each >> bits
    starts = np.searchsorted(owner, np.arange(len(at) + 1))
    sizes = np.diff(starts)
    x, y = (np.fromiter(map(at.__getitem__, side), np.int64, len(side)) for side in (a, b))
    # both sets of each pair, marked with the pair: what comes twice is shared
    which = np.concatenate([x, y])
    pair = np.repeat(np.concatenate([np.arange(len(x))] * 2), sizes[which])
    place = np.arange(len(pair)) - np.repeat(np.cumsum(sizes[which]) - sizes[which], sizes[which]) + np.repeat(starts[which], sizes[which])
    both = np.sort(pair << bits | each[place] & (1 << bits) - 1)
    twice = both[1:][both[1:] == both[:-1]] >> bits
    return sizes[x], sizes[y], np.bincount(twice, minlength=len(x))


def similar(pairs):
    """Arrow batches (a, a_more, b, b_more, a_line, b_line) -> the first four columns of similar pairs."""
    for batch in pairs:
        a, b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        keep, k = np.zeros(batch.num_rows, bool), 0
        while k < len(a):
            stop, held = k, 0
            while stop < len(a) and held < CHUNK and stop - k < 4096:
                held += len(a[stop]) + len(b[stop])
                stop += 1
            n, m, inter = shared_shingles(a[k:stop], b[k:stop])
            keep[k:stop] = inter >= SIMILAR * (n + m - inter)
            k = stop
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:4]], ["a", "a_more", "b", "b_more"])


def wanted_lines(docs):
    """Arrow batches (text, lines: list of (line_no, id, more)) -> id, more, line (normalised)."""
    for batch in docs:
        out = []
        for text, lines in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            split = text.as_py().split("\n")
            out += [(x["id"], x["more"], normal(split[x["line_no"]])) for x in lines]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["id", "more", "line"])


def lines_of(ids: DataFrame, signed: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, more, line) of the lines of ids (id), stored."""
    ship(docs.sparkSession)
    ids = small(stored(ids.distinct(), "ids"))
    # one place of each line, and from there its text
    places = signed.select("id", "more", *KEY, "line_no").join(ids, "id", "left_semi").groupBy("id", "more").agg(F.min(F.struct(*KEY, "line_no")).alias("at")).select("id", "more", "at.*")
    places = places.groupBy(*KEY).agg(F.collect_list(F.struct("line_no", "id", "more")).alias("lines"))  # a document bounds its lines
    places = stored(places, "places")
    found = docs.select(*row_key(), "text").join(small(places, F.size("lines")), KEY).select("text", "lines")
    texts = stored(found.mapInArrow(wanted_lines, "id long, more long, line string").dropDuplicates(["id", "more"]), "lines")
    for x in (ids, places):
        discard(x)
    return texts


def sketches(batches):
    """Arrow batches (id, line) -> id, n, the size of its set of shingles, and p0 .., FOLD longs: the parity sketch of the set."""
    cells = 64 * FOLD
    for batch in batches:
        lines, sizes, words, k = batch.column(1).to_pylist(), [], [], 0
        while k < len(lines):
            stop, held = k, 0
            while stop < len(lines) and held < CHUNK and stop - k < 1024:
                held += len(lines[stop])
                stop += 1
            codes, line, bits = shingle_codes(lines[k:stop])
            once = np.unique(line << bits | codes, return_index=True)[1]
            cell = line[once] * cells + (shingle_hashes(lines[k:stop])[0][once] & np.uint32(cells - 1))
            odd = (np.bincount(cell, minlength=(stop - k) * cells) & 1).astype(np.uint8)
            sizes.append(np.bincount(line[once], minlength=stop - k))
            words.append(np.packbits(odd, bitorder="little").view("<i8").reshape(-1, FOLD))
            k = stop
        if lines:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), *map(pa.array, np.ascontiguousarray(np.concatenate(words).T))], ["id", "n", *[f"p{w}" for w in range(FOLD)]])


def sets_allow() -> Column:
    """Exact bound on pairs with the sizes and the parity sketches of their sets, l.n, l.p0 .. and r.n, r.p0 ..: what a sketch
    tells apart is in one of the two sets only."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"l.p{w}").bitwiseXOR(F.col(f"r.p{w}"))) for w in range(FOLD)])
    a, b = F.col("l.n"), F.col("r.n")
    shared = F.least(F.floor((a + b - differ) / 2), a, b)
    return shared >= SIMILAR * (a + b - shared)


def verified(pairs: DataFrame, bits: DataFrame, signed: DataFrame, docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """pairs (a, b) of ids -> stored pairs (u, v) of identities whose lines are similar. texts: lines, theirs among them, if at hand."""
    ship(docs.sparkSession)
    each = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = bits.alias("l"), bits.alias("r")
    met = each.join(left, F.col("a") == F.col("l.id")).join(right, F.col("b") == F.col("r.id")).where(may_link()).select("a", "b")
    met = stored(met.distinct(), "pairs")
    ids = met.select(F.col("a").alias("id")).union(met.select(F.col("b").alias("id")))
    if texts is None:
        own = [lines_of(ids, signed, docs)]
        texts = own[0]
    else:
        own = [stored(ids.distinct(), "ids")]
        texts = texts.join(small(own[0]), "id", "left_semi")
    both = met.join(texts.toDF("a", "a_more", "a_line"), "a").join(texts.toDF("b", "b_more", "b_line"), "b").select("a", "a_more", "b", "b_more", "a_line", "b_line")
    linked = both.mapInArrow(similar, "a long, a_more long, b long, b_more long")
    out = stored(linked.select(F.struct(F.col("a").alias("id"), F.col("a_more").alias("more")).alias("u"), F.struct(F.col("b").alias("id"), F.col("b_more").alias("more")).alias("v")), "linked")
    for x in (met, *own):
        discard(x)
    return out


def line_components(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of the lines that are similar to others; identities are structs (id, more)."""
    met = shared_buckets(signed)
    bits = stored(signed.select("id", *[f"m{w}" for w in range(WORDS)]).distinct(), "bits")
    linked = [verified(met.select(F.col("id").alias("a"), F.col("hub").alias("b")), bits, signed, docs)]
    comp = components(linked[0])

    def still_open(rows: DataFrame) -> DataFrame:
        """(bucket, id, comp) of the buckets whose lines are in several components."""
        known = small(comp.select(F.col("node.id").alias("node"), F.col("component.id").alias("comp")))
        now = rows.join(known, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"))
        several = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        return stored(now.join(several, "bucket", "left_semi"), "open")

    now = still_open(met.where("id != hub").select("bucket", "id"))
    if now.take(1):
        # a second star, around a line that a hash picks
        order = F.xxhash64("id", "bucket")
        centre = now.groupBy("bucket").agg(F.min_by("id", order).alias("centre"), F.min_by("comp", order).alias("centre_comp"))
        linked.append(verified(now.join(centre, "bucket").where("comp != centre_comp").select(F.col("id").alias("a"), F.col("centre").alias("b")), bits, signed, docs))
        discard(comp)
        comp = components(reduce(DataFrame.union, linked))
        last = still_open(now.join(centre, "bucket").where("id != centre").select("bucket", "id"))
        # most pairs that the bits let through are less similar; the sets' sketches tell them apart before they leave the join.
        # A pair that meets in several buckets leaves it in the first: there it is in `last`, too, unless a star had it
        texts = lines_of(last.select("id"), signed, docs)
        kind = "id long, n long, " + ", ".join(f"p{w} long" for w in range(FOLD))
        sets = stored(texts.select("id", "line").mapInArrow(sketches, kind), "sets")
        ids = small(stored(last.select("id").distinct(), "ids"))
        of = signed.join(ids, "id", "left_semi").select("id", "buckets").distinct()
        each = last.join(bits, "id").join(sets, "id").join(of, "id").where(F.array_contains("buckets", F.col("bucket")))
        each = each.withColumn("before", F.slice("buckets", F.lit(1), (F.array_position("buckets", F.col("bucket")) - 1).cast("int"))).drop("buckets")
        left, right = each.alias("l"), each.alias("r")
        first = ~F.arrays_overlap("l.before", "r.before")
        pairs = left.join(right, (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.comp") < F.col("r.comp")) & may_link() & sets_allow() & first)
        across = stored(pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct(), "across")
        if across.take(1):
            linked.append(verified(across, bits, signed, docs, texts))
            discard(comp)
            comp = components(reduce(DataFrame.union, linked))
        for x in (last, across, sets, texts, ids):
            discard(x)
    for x in (now, met, bits, *linked):
        discard(x)
    return comp


def find_duplicates(docs: DataFrame, signed: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_key, text_hash, removed (ascending numbers of the lines to remove), stored; only documents that lose lines."""
    signed = sign(docs) if signed is None else signed
    comp = line_components(signed, docs)
    known = small(stored(comp.select("node.*", F.col("component.id").alias("c_id"), F.col("component.more").alias("c_more")), "components"))
    places = signed.select(*KEY, "line_no", "id", "more").join(known, ["id", "more"], "left")
    group = ["class_id", "class_more"]
    places = places.select(*KEY, "line_no", F.coalesce("c_id", "id").alias("class_id"), F.coalesce("c_more", "more").alias("class_more"))
    # classes of several places; rows that repeat doc_id and text have the same places, which do no harm
    several = stored(places.groupBy(*group).agg(F.count("*").alias("n"), F.min("doc_key").alias("least")).where("n > 1"), "several")
    hot = signed.count() // HOT
    often = several.where(F.col("n") > hot).drop("n")  # at most HOT rows
    rest = places.join(F.broadcast(often), group, "left_anti").join(several.where(F.col("n") <= hot).drop("n"), group)
    copies = stored(places.join(F.broadcast(often), group).unionByName(rest), "copies")
    # the first place: in the least document, by the hash of its text and the number of the line
    place = F.struct("text_hash", "line_no")
    first = copies.where(F.col("doc_key") == F.col("least")).groupBy(*group).agg(F.min(place).alias("first"))
    first = stored(first, "first")
    later = [F.col("doc_key") != F.col("least"), place != F.col("first")]
    mine = copies.where(~later[0])
    lost = copies.where(later[0]).select(*KEY, "line_no").unionByName(mine.join(small(first), group).where(later[1]).select(*KEY, "line_no"))
    out = stored(lost.groupBy(*KEY).agg(F.array_sort(F.collect_set("line_no")).alias("removed")), "removed")
    for x in (several, copies, first, known, comp):
        discard(x)
    return out


def repeated_rows(docs: DataFrame, signed: DataFrame, keep=lambda df: df) -> DataFrame:
    """docs as (row, doc_key, text_hash, again); again is true for rows that repeat doc_id and text of another one with lines
    that count, but for one of them."""
    again = stored(signed.where("first").groupBy(*KEY).count().where("count > 1").select(*KEY), "repeated")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())
    if not again.take(1):
        return keyed.withColumn("again", F.lit(False))
    some = small(keep(again))
    # written once, so that the numbers hold
    copies = keep(stored(keyed.join(some, KEY, "left_semi").withColumn("number", F.monotonically_increasing_id()), "copies"))
    first = copies.groupBy(*KEY).agg(F.min(F.struct(F.xxhash64("row"), "number")).alias("first")).select(*KEY, F.col("first.number").alias("kept"))
    marked = copies.join(first, KEY).select("row", *KEY, (F.col("number") != F.col("kept")).alias("again"))
    return keyed.join(some, KEY, "left_anti").withColumn("again", F.lit(False)).unionByName(marked)


def remove_lines(docs: DataFrame) -> DataFrame:
    """docs with new texts and n_lines, n_removed, removed (numbers of the removed lines)."""
    old = list(docs.columns)
    with temporary(docs.sparkSession) as keep:
        signed = sign(docs)
        removed = keep(find_duplicates(docs, signed))
        marked = repeated_rows(docs, signed, keep)
    out = marked.join(small(removed, F.size("removed")), KEY, "left")
    whole = F.split("row.text", "\n")
    counted = F.filter(F.transform(whole, lambda x, i: F.when(F.char_length(F.lower(F.trim(x))) >= LEAST_CHARS, i)), lambda i: i.isNotNull())
    none = F.array().cast("array<int>")
    gone = F.when(F.col("again"), F.coalesce(counted, none)).otherwise(F.coalesce("removed", none))
    out = out.select("row", gone.alias("gone"))
    text = F.when(F.size("gone") == 0, F.col("row.text")).otherwise(F.array_join(F.filter(whole, lambda _, i: ~F.array_contains("gone", i)), "\n"))
    new = {"n_lines": F.coalesce(F.size(whole), F.lit(0)).cast("long"), "n_removed": F.size("gone").cast("long"), "removed": F.col("gone")}
    kept = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in old if c not in new]
    return out.select(*kept, *[v.alias(k) for k, v in new.items()])


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """For each document: its lines, how many go, their numbers, and the hash of the text that remains."""
    out = remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
