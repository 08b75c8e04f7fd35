"""Personal data by bootstrapped contextual extraction, with DataFrame operations only.

1. Seeds: the leftmost non-overlapping matches of four base patterns (email, ip, card, phone), all places in whole texts.
2. Candidates: matches of four looser patterns (obfuscated addresses, hexadecimal groups, digits in groups with or without
   blanks and brackets) that overlap no seed.
3. Lexical patterns: the words around a seed or candidate, lower-cased, digits as #: two before, two after, one on each side.
4. The graph of patterns and instances (distinct strings) of each kind is scored in rounds: a pattern that at least SUPPORT
   distinct sure instances have, and that hardly any unsure one has (their share, smoothed, is at least SCORE), makes its other
   instances sure. These induce patterns of their own in the next round, until no instance is added. Seeds are sure from the
   start. All places of sure instances are spans.
Scores are joined and aggregated in Spark; every round is written to the shared folder.

Offsets count code points. Possessive quantifiers and \\G (the end of the match before) keep the patterns linear in the
length of a text without changing what the base ones match: a run of letters or digits is entered at its start only.

Defined cases: a null text is an empty one; rows with one doc_id and one text get the same result each, rows with one
doc_id and different texts their own; a null doc_id is a document like any other; an empty table gives an empty one; other
columns are ignored. An added span overlaps no base span, and of added spans that overlap the one of the earlier kind stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import discard, stored, table, temporary

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without such a character has no match, and needs no pattern.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?+(?:@|\(at\)|\[at\])\x20?+[A-Za-z0-9-]++(?:\x20?+(?:\.|\(dot\)|\[dot\])\x20?+[A-Za-z0-9-]++)*+",
    "ip": r"(?:(?<![0-9A-Za-z.:])|\G)[0-9a-fA-F]{1,4}+(?:[.:][0-9a-fA-F]{1,4}+){3,7}+",
    "card": r"(?:(?<![0-9A-Za-z])|\G)[0-9]{4}+(?:[\x20.-]?+[0-9]{4}+){2,3}+(?:[\x20.-]?+[0-9]{1,3}+)?+",
    "phone": r"(?:(?<![0-9A-Za-z])|\G)\(?+[0-9]{2,5}+\)?+(?:[\x20./-]{1,2}+\(?+[0-9]{2,5}+\)?+){1,4}+",
}
LOOSE_NEEDS = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9a-fA-F][.:][0-9a-fA-F]", "card": r"[0-9]{4}", "phone": r"[0-9]{2}"}
SUPPORT, SCORE, SMOOTH = 4, 0.8, 0.5
#: Characters on each side of a match in which its context lies.
REACH = 256
KEY = ["doc_key", "text_hash"]


def row_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_key"), F.xxhash64("text").alias("text_hash")]


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """number: digits only."""
    n = F.length(number)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(number, i, 1).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    d = digits(match)
    if kind == "ip":
        # parts of over three digits may still be small: leading zeros count for nothing
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).isin(0, 1, 2) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    if kind == "card":
        return F.length(d).between(16, 19) & luhn(d)
    if kind == "phone":
        return F.length(d).between(8, 15)
    return F.lit(True)


def near(gap: Column, side: str) -> Column:
    """The last (before) or first (after) two words of what stands between two matches, as far as they lie within REACH
    characters, lower-cased, digits as #."""
    some = F.right(gap, F.lit(REACH)) if side == "before" else F.left(gap, F.lit(REACH))
    plain = F.translate(F.lower(some), "0123456789\t\n\x0b\f\r", "##########     ")
    words = F.array_remove(F.split(plain, r"\x20+"), "")
    return F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2) if side == "before" else F.slice(words, 1, 2)


def matches(kind: str, text: Column, pattern: str, present: Column | None) -> Column:
    """Arrays of struct(kind, i, match, gap, before, after): gap is the length of what stands between the match and the one
    before, before and after the words on its sides."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if present is not None:
        found = F.when(present, found).otherwise(F.array().cast("array<string>"))
    if pattern == BASE["card"]:  # single digits are no match, and most numbers are short
        found = F.when(F.exists(found, lambda m: F.length(m) >= 16), found).otherwise(F.array().cast("array<string>"))
    gaps = F.split(text, pattern, -1)
    each = lambda m, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), m.alias("match"), F.length(F.get(gaps, i)).alias("gap"), near(F.get(gaps, i), "before").alias("before"), near(F.get(gaps, i + 1), "after").alias("after"))
    return F.when(F.size(found) > 0, F.transform(found, each))


MATCH = "struct<kind:int,i:int,match:string,gap:int,before:array<string>,after:array<string>>"


def spans_of(docs: DataFrame, patterns: dict[str, str], present: dict[str, Column | None]) -> DataFrame:
    """docs (doc_id, text) -> doc_key, text_hash, kind (its number in KINDS), start, stop, match, before, after of all matches."""
    rows = docs.select(*row_key(), "text")
    rows = rows.select(*KEY, *[matches(k, F.col("text"), patterns[k], present[k]).alias(k) for k in KINDS]).where(reduce(Column.__or__, [F.col(k).isNotNull() for k in KINDS]))
    none = F.array().cast(f"array<{MATCH}>")
    found = rows.select(*KEY, F.explode(F.concat(*[F.coalesce(F.col(k), none) for k in KINDS])).alias("m"))
    # no text goes further than this: only the matches, the lengths of gaps and a few words are shuffled
    found = found.select(*KEY, "m.*").dropDuplicates([*KEY, "kind", "i"])
    order = W.partitionBy(*KEY, "kind").orderBy("i")
    found = found.withColumn("stop", F.sum(F.col("gap") + F.length("match")).over(order).cast("int")).withColumn("start", F.col("stop") - F.length("match"))
    return found.select(*KEY, "kind", "start", "stop", "match", "before", "after")


def base_spans(docs: DataFrame) -> DataFrame:
    """The matches of the base patterns that hold."""
    present = {k: None if c is None else F.instr("text", c) > 0 for k, c in NEEDS.items()}
    found = spans_of(docs, BASE, present)
    true = reduce(Column.__or__, [(F.col("kind") == i) & holds(k, F.col("match")) for i, k in enumerate(KINDS)])
    return found.where(true)


def outside(spans: DataFrame, held: DataFrame) -> DataFrame:
    """spans that overlap none of held."""
    h = held.select(*[F.col(k).alias(f"h_{k}") for k in KEY], F.col("start").alias("h_start"), F.col("stop").alias("h_stop"))
    on = [*[F.col(k) == F.col(f"h_{k}") for k in KEY], F.col("start") < F.col("h_stop"), F.col("h_start") < F.col("stop")]
    return spans.join(h, on, "left_anti")


def contexts(spans: DataFrame, seed: bool) -> DataFrame:
    """kind, pattern, instance of each span: two words before, two after, one on each side; where there are that many."""
    two = lambda c: F.when(F.size(c) == 2, F.concat_ws(" ", c))
    last, first = F.get("before", F.size("before") - 1), F.get("after", 0)
    both = F.when(last.isNotNull() & first.isNotNull(), F.concat(F.lit("m "), last, F.lit(" _ "), first))
    each = spans.select("kind", F.col("match").alias("instance"), F.explode(F.array(F.concat(F.lit("b "), two("before")), F.concat(F.lit("a "), two("after")), both)).alias("pattern"))
    return each.where("pattern is not null").withColumn("seed", F.lit(int(seed)))


def discovered(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans that the patterns add: doc_key, text_hash, kind, start, stop; none overlaps a base span."""
    present = {k: F.col("text").rlike(p) for k, p in LOOSE_NEEDS.items()}
    words = stored(outside(spans_of(docs, LOOSE, present), spans), "candidates")
    # an edge for each pattern and distinct instance; patterns of fewer than SUPPORT instances can never count
    edges = contexts(spans, True).unionByName(contexts(words, False)).groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = stored(edges, "edges")
    often = stored(edges.groupBy("kind", "pattern").agg(F.count("*").alias("n"), F.sum("seed").alias("seeds")).where((F.col("n") >= SUPPORT) & (F.col("n") > F.col("seeds"))).select("kind", "pattern", "n"), "patterns")
    graph = stored(edges.join(often, ["kind", "pattern"]), "graph")
    sure = stored(graph.where("seed = 1").select("kind", "instance").distinct(), "sure")
    added = words.select("kind", F.col("match").alias("instance")).where("false")
    size = sure.count()
    while size:
        hit = graph.join(sure, ["kind", "instance"], "left_semi").groupBy("kind", "pattern", "n").agg(F.count("*").alias("k"))
        good = hit.where((F.col("k") >= SUPPORT) & (F.col("k") / (F.col("n") + SMOOTH) >= SCORE)).select("kind", "pattern")
        new = stored(graph.join(good, ["kind", "pattern"], "left_semi").select("kind", "instance").union(sure).distinct(), "sure")
        discard(sure)
        sure, before = new, size
        size = sure.count()
        if size == before:
            added = sure
            break
    places = words.join(added.withColumnRenamed("instance", "match"), ["kind", "match"], "left_semi").select(*KEY, "kind", "start", "stop")
    places = stored(places, "places")
    out = reduce(DataFrame.unionByName, [outside(places.where(F.col("kind") == i), places.where(F.col("kind") < i)) for i in range(len(KINDS))])
    out = stored(out, "discovered")
    for x in (words, edges, often, graph, sure, places):
        discard(x)
    return out


def digest_list(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, for each row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    span = F.struct("kind", "start", "stop")
    with temporary(docs.sparkSession) as keep:
        base = stored(base_spans(docs), "base")
        both = base.select(*KEY, span.alias("s"), F.lit(True).alias("is_base")).union(discovered(docs, base).select(*KEY, span, F.lit(False)))
        counts = [F.count_if(F.col("is_base") & (F.col("s.kind") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
        found = keep(stored(both.groupBy(*KEY).agg(*counts, F.collect_list(F.when(F.col("is_base"), F.col("s"))).alias("base"), F.collect_list("s").alias("all")), "found"))
    none = F.array().cast("array<struct<kind:int,start:int,stop:int>>")
    rows = docs.select("doc_id", *row_key()).join(found, KEY, "left")
    base_, all_ = F.coalesce("base", none), F.coalesce("all", none)
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(digest_list(base_), 256).alias("base_sha256"), digest_list(all_).alias("spans"), (F.size(all_) - F.size(base_)).cast("long").alias("n_added"))


def op7_personal(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
