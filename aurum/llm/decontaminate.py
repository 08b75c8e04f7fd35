"""Benchmark decontamination over a distributed positional inverted index, with DataFrame operations only.

The index is a stored table of postings (term, next, doc_key, text_hash, pos): term and next are the 64-bit hashes of a word
and of the word after it (null at the end, and for words that the index leaves out), pos counts the words of a document
from 0. Phrase matching takes, by the corpus counts of the postings, each phrase's rarest pair of neighbouring terms, turns
the postings of that pair into candidate starts (position less the pair's offset in the phrase), and intersects them with
the offset-adjusted postings of the phrase's other terms. Proximity matching joins the postings of the rarest
term with those of the other terms in buckets of the distance asked for.

Words: A-Z lower-cased, then runs of digits, a-z and characters beyond ASCII.

build_index() indexes all words of a corpus, or only those that given terms name; the query does the second, with the words of
the benchmark it is asked about.

Defined cases: an item with a null item_id makes its windows hit, but is named and counted in no list of items; a null text has no words; rows with one doc_id and one text get the same result each; rows with one doc_id
and different texts are kept apart by the hash of the text; an empty benchmark hits nothing; items without words are no
windows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ascii_lower, small, stored, table, temporary

KEY = ["doc_key", "text_hash"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def row_key() -> list[Column]:
    """doc_key is the doc_id, with a value of its own for null."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The postings of docs (doc_id, text), stored; of the given terms (column term: hashes of words) only, if there are any given."""
    rows = docs.select(*row_key(), words(F.col("text")).alias("words")).select(*KEY, F.posexplode("words").alias("pos", "word"), "words")
    rows = rows.select(*KEY, "pos", F.xxhash64("word").alias("term"), F.when(F.col("pos") < F.size("words") - 1, F.xxhash64(F.get("words", F.col("pos") + 1))).alias("next"))
    if terms is not None:
        known = small(terms)
        rows = rows.join(known, "term", "left_semi").join(known.select(F.col("term").alias("after")), F.col("next") == F.col("after"), "left").select(*KEY, "pos", "term", F.col("after").alias("next"))
    return stored(rows, "postings")


def phrases(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """items (item_id, text) -> the distinct windows (phrase, terms: hashes of words) and (phrase, item_id), both stored.

    A window has `size` words; an item of fewer, but not none, is one window."""
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = cut.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))))
    cut = cut.select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("terms")).distinct()
    cut = cut.withColumn("phrase", F.sha2(F.array_join("terms", " "), 256)).withColumn("terms", F.transform("terms", lambda w: F.xxhash64(w)))
    named = stored(cut, "phrases")
    return stored(named.select("phrase", "terms").distinct(), "windows"), named.select("phrase", "item_id")


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """windows (phrase, terms) -> every occurrence: doc_key, text_hash, start, length, phrase."""
    length = F.size("terms")
    each = windows.where(length > 1).select("phrase", "terms", F.explode(F.sequence(F.lit(0), length - 2)).alias("offset"))
    each = stored(each.select("phrase", "terms", "offset", F.get("terms", F.col("offset")).alias("term"), F.get("terms", F.col("offset") + 1).alias("next")), "pairs")
    pair = ["term", "next"]
    counts = index.join(small(each.select(*pair).distinct()), pair, "left_semi").groupBy(*pair).count()
    # a phrase with a pair that the corpus lacks can't occur
    rarest = each.join(counts, pair).groupBy("phrase", "terms").agg(F.min(F.struct("count", *pair, "offset")).alias("best"), F.count("*").alias("n")).where("n = size(terms) - 1")
    rest = F.filter(F.transform("terms", lambda t, i: F.struct(i.alias("offset"), t.alias("term"))), lambda x: (x["offset"] != F.col("best.offset")) & (x["offset"] != F.col("best.offset") + 1))
    plan = stored(rarest.select("phrase", length.alias("length"), "best.term", "best.next", "best.offset", rest.alias("rest")), "plan")
    start = (F.col("pos") - F.col("offset")).alias("start")
    found = index.join(small(plan), pair).select(*KEY, start, "phrase", "length", "rest").where("start >= 0")
    found = stored(found, "candidates")
    kept = [*KEY, "start", "phrase", "length"]
    # all lists of a document meet in one partition
    want = found.where("length > 2").repartition(*KEY).select(*kept, F.explode("rest").alias("want")).select(*kept, (F.col("start") + F.col("want.offset")).alias("pos"), "want.term")
    got = want.join(index.select(*KEY, "pos", "term").repartition(*KEY), [*KEY, "pos", "term"], "left_semi")
    whole = got.groupBy(*kept).agg(F.count_distinct("pos").alias("n")).where("n = length - 2").select(*kept)
    single = small(stored(windows.where(length == 1).select("phrase", length.alias("length"), F.get("terms", F.lit(0)).alias("term")), "single"))
    return whole.union(found.where("length = 2").select(*kept)).union(index.join(single, "term").select(*KEY, "pos", "phrase", "length"))


def proximity_matches(index: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """queries (query, terms: hashes of words) -> doc_key, text_hash, query, pos: occurrences of the query's rarest term that have every
    other term of the query at most `within` words away."""
    each = queries.select("query", F.explode(F.array_distinct("terms")).alias("term"))
    rank = F.row_number().over(W.partitionBy("query").orderBy("count", "term"))
    ranked = stored(each.join(index.groupBy("term").count(), "term", "left").withColumn("rank", rank).withColumn("terms", F.count("*").over(W.partitionBy("query"))), "proximity")
    first = index.join(small(ranked.where("rank = 1").select("query", "term", "terms")), "term")
    near = [first.withColumn("bucket", F.floor(F.col("pos") / within).cast("int") + d) for d in (-1, 0, 1)]
    anchors = reduce(DataFrame.union, near).select(*KEY, "query", "terms", F.col("pos").alias("at"), "bucket")
    others = index.join(small(ranked.where("rank > 1").select("query", "term")), "term").withColumn("bucket", F.floor(F.col("pos") / within).cast("int"))
    got = anchors.join(others, [*KEY, "query", "bucket"]).where(F.abs(F.col("pos") - F.col("at")) <= within)
    met = got.groupBy(*KEY, "query", "terms", "at").agg(F.count_distinct("term").alias("n")).where("n = terms - 1").select(*KEY, "query", F.col("at").alias("pos"))
    return met.union(first.where("terms = 1").select(*KEY, "query", "pos"))


def occurring(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """doc_key, text_hash, n_hit (words inside any occurrence of a window), items (sorted ids); documents with hits only, stored."""
    windows, owners = phrases(items, size)
    terms = stored(windows.select(F.explode("terms").alias("term")).distinct(), "terms")
    hits = phrase_matches(build_index(docs, terms), windows).distinct()
    order = W.partitionBy(*KEY).orderBy("start", "length")
    stop = F.col("start") + F.col("length")
    fresh = hits.withColumn("seen", F.max(stop).over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("fresh", F.greatest(F.lit(0), stop - F.greatest("start", F.coalesce("seen", "start"))))
    covered = stored(fresh.groupBy(*KEY).agg(F.sum("fresh").alias("n_hit"), F.collect_set("phrase").alias("found")), "hits")
    named = covered.select(*KEY, F.explode("found").alias("phrase")).join(small(owners), "phrase").groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return stored(covered.select(*KEY, "n_hit").join(named, KEY), "found")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the row's key for each row of docs."""
    with temporary(docs.sparkSession) as keep:
        found = keep(occurring(docs, items, size))
    rows = docs.select("doc_id", *row_key(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, KEY, "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *KEY)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(*KEY)
