"""The training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import gzip
import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aurum.llm import common, decontaminate, line_dedup, personal, pieces, prefix_join, quality, reshard, token_pack, vector_join, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, start string, score string"
AWKWARD = [None, "", " ", "\n\n", "a", "word " * 3000, "x" * 20000, "İstanbul ﬁ ß \x00 \x1c 日本語 é", "<|endoftext|> '" + "'s", "▁▁x  y", "0 " * 500]


def table(spark, texts, start=0):
    rows = [(start + k, t, "en", "src0", None, "clash", "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=200):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(words)}" for _ in range(n))


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("local", [0, common.LOCAL_LINKS])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL_LINKS", local)
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + rng.randrange(1, 50)) for _ in range(60)] + [(7, 7), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_of({x for p in links for x in p}, links)
    assert got == want
    pairs = spark.createDataFrame([((1, 2), (1, 1)), ((1, 2), (0, 9)), ((5, 5), (5, 5)), ((7, 1), (7, 0))], "a struct<x:long,y:long>, b struct<x:long,y:long>")
    assert {tuple(r["node"]): tuple(r["component"]) for r in common.components(pairs).collect()} == {(1, 2): (0, 9), (1, 1): (0, 9), (0, 9): (0, 9), (7, 1): (7, 0), (7, 0): (7, 0)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 ----------------------------------------------------------------------------------------------------------------------


def test_machine_scores_by_the_identity_what_all_pairs_give():
    rng = np.random.default_rng(0)
    m = quality.Machine(np.zeros((len(quality.STATISTICS), quality.BINS - 1)), 0.1, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, quality.FACTORS)) * 0.2)
    text = "Some words, some other words.\nAnd a line | of bars!"
    i, x = m.rows(quality.features(text))
    z = m.bias + m.linear[i] @ x + sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
    assert math.isclose(m.score(text), 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(2)
    good = [prose(rng, 80) + "." for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 80).split()) for _ in range(60)]
    docs = table(spark, good + bad + AWKWARD)
    labels = spark.createDataFrame([(k, int(k < 120), None) for k in range(180)] + [(0, 1, None), (None, 1, None), (3, None, None)], "doc_id long, quality int, score string")
    model = quality.train(docs, labels)
    got = quality.scored(docs, model).select("doc_id", "quality_score", quality.held_out("doc_id").alias("h")).collect()
    assert len(got) == 180 + len(AWKWARD) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert all((r["quality_score"] >= 0.3) == (r["doc_id"] < 120) for r in got if r["h"] and r["doc_id"] < 180)
    assert {r["doc_id"] for r in got if r["h"]} == {k for k in range(180 + len(AWKWARD)) if zlib.crc32(str(k).encode()) % 5 == 0}


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)]])
def test_quality_without_two_classes(spark, labels):
    docs = table(spark, ["a b", None, "c"])
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len({r[0] for r in quality.scored(docs, model).select("quality_score").collect()}) == 1


# 2 ----------------------------------------------------------------------------------------------------------------------


def test_flow_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(20):
        supply = [rng.randrange(30) for _ in range(3)]
        capacity = [sum(supply) // 4 + 1] * 4
        cost = [[rng.randrange(4) for _ in range(4)] for _ in range(3)]
        flow = reshard.min_cost_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply and all(sum(r[j] for r in flow) <= capacity[j] for j in range(4))
        # no cycle or path through spare room lowers the cost
        spent = sum(cost[i][j] * flow[i][j] for i in range(3) for j in range(4))
        from itertools import product

        for i, a, b, k in product(range(3), range(4), range(4), range(3)):
            if flow[i][a] and sum(r[b] for r in flow) < capacity[b]:
                assert cost[i][b] >= cost[i][a]
            if flow[i][a] and flow[k][b]:
                assert cost[i][b] + cost[k][a] >= cost[i][a] + cost[k][b], spent
    with pytest.raises(ValueError):
        reshard.min_cost_flow([5], [4], [[0]])


def test_reshard_and_rewrite(spark, tmp_path):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(60)) for _ in range(400)] + AWKWARD + ["same"] * 30
    docs = table(spark, texts)
    old = F.when(F.col("doc_id") < 300, 0).otherwise(F.col("doc_id") % 3)
    plan = common.stored(reshard.reshard(docs, old, 3, 4), "plan")
    rows = plan.collect()
    assert len(rows) == len(texts)
    sums, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sums.values()) - min(sums.values()) <= 20001
    changed = reshard.rewrite(docs, old, plan, str(tmp_path / "out"), 4)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r[0] for r in written.select("shard").distinct().collect()) == changed
    assert written.count() == sum(len(slots[s]) for s in changed)
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in written.collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows if r["shard"] in changed)
    assert reshard.reshard(docs.where("false"), F.lit(0), 3, 4).count() == 0


def test_rewrite_keeps_every_row_and_drops_shards_that_are_no_more(spark, tmp_path):
    path = str(tmp_path / "shards")
    docs = spark.createDataFrame([(k if k % 5 else None, f"text {k % 7}" if k % 3 else None, "x") for k in range(40)] + [(1, "text 1", "x")] * 3, "doc_id long, text string, slot string")
    old = F.pmod(F.xxhash64("text", "doc_id"), F.lit(4)).cast("int")
    docs.drop("slot").withColumn("shard", old).withColumn("slot", F.lit(0).cast("long")).write.partitionBy("shard").parquet(path)
    plan = common.stored(reshard.reshard(docs, old, 4, 2), "plan")
    reshard.rewrite(docs, old, plan, path, 2)
    got = spark.read.parquet(path)
    assert {r[0] for r in got.select("shard").distinct().collect()} <= {0, 1}
    key = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows.collect())
    assert key(got) == key(docs), "no row is lost and none comes twice"
    for r in got.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect():
        assert r["s"] == list(range(len(r["s"])))


def test_few_moves_when_the_shards_fit(spark):
    docs = table(spark, ["abcd"] * 40)
    assert reshard.reshard(docs, F.col("doc_id") % 4, 4, 4).where("old_shard != shard").count() == 0


# 3 ----------------------------------------------------------------------------------------------------------------------


def brute_lines(texts):
    places = defaultdict(list)
    for d, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip(" ").lower()
            if len(line) >= line_dedup.LEAST_CHARS:
                places[line].append((d, k))
    names = sorted(places)
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in names]
    links = [(a, b) for a in range(len(names)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = defaultdict(list)
    for k, c in components_of(range(len(names)), links).items():
        groups[c] += places[names[k]]
    return {p for g in groups.values() for p in sorted(g)[1:]}


def test_line_dedup(spark):
    rng = random.Random(5)
    lines = [prose(rng, 30, 1000) for _ in range(40)]
    near = [" ".join(w if rng.random() > 0.04 else "zzz" for w in rng.choice(lines).split()) for _ in range(40)]
    pool = lines + near + ["short", "short"]
    texts = ["\n".join(rng.choice(pool) for _ in range(4)) for _ in range(40)] + AWKWARD
    docs = table(spark, texts).withColumn("n_lines", F.lit("clash"))
    got = {r["doc_id"]: r for r in line_dedup.remove_lines(docs).collect()}
    assert len(got) == len(texts)
    gone = {(d, k) for d, r in got.items() for k in r["removed"]}
    want = brute_lines(texts)
    assert not gone - want and len(gone) >= 0.95 * len(want)
    for d, r in got.items():
        kept = None if texts[d] is None else "\n".join(x for k, x in enumerate(texts[d].split("\n")) if (d, k) not in gone)
        assert r["text"] == kept and r["n_removed"] == len(r["removed"])
    assert line_dedup.remove_lines(docs.where("false")).count() == 0


def test_prefix_join_tells_texts_of_one_id_apart(spark):
    rng = random.Random(21)
    a, b = prose(rng, 80, 900), prose(rng, 80, 900)
    docs = spark.createDataFrame([(5, a), (5, b), (3, b + " tail"), (5, a), (None, a), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in prefix_join.linked_components(docs).collect())
    assert got == [(0, 0), (0, 0), (3, 3), (5, 3), (5, 5), (5, 5)]


def test_line_dedup_repeated_rows(spark):
    line = "this line is long enough to count here"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line.upper()), (None, "  " + line), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in line_dedup.remove_lines(docs).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1)]
    twice = spark.createDataFrame([(3, line, "a"), (3, line, "a"), (3, line, "b"), (4, "other " + line[::-1], "c")], "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in line_dedup.remove_lines(twice).collect())
    assert got == [(3, 0), (3, 1), (3, 1), (4, 0)], "of rows that repeat one document one keeps the line"


def found_pairs(spark, pairs):
    """How many pairs (line, near copy) lose the near copy."""
    docs = table(spark, ["\n".join(x for p in pairs for x in p)])
    gone = set(line_dedup.remove_lines(docs).first()["removed"])
    return sum(2 * k + 1 in gone for k in range(len(pairs)))


def shingle_similarity(a, b):
    a, b = ({x[i : i + 5] for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_line_dedup_recall_at_the_threshold(spark):
    rng, pairs = random.Random(15), []
    while len(pairs) < 400:
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(rng.choice([50, 100, 250]))).strip()
        line = "x".join(line.split("  "))
        near = list(line)
        for _ in range(max(1, round(len(line) * rng.uniform(0.01, 0.03)))):
            near[rng.randrange(1, len(near) - 1)] = rng.choice("0123456789")
        if 0.8 <= shingle_similarity(line, "".join(near)) < 0.9:
            pairs.append((line, "".join(near)))
    assert found_pairs(spark, pairs) >= 0.97 * len(pairs)


def test_line_dedup_without_blanks(spark):
    rng, pairs = random.Random(16), []
    letters = "".join(chr(0x4E00 + k) for k in range(900))
    while len(pairs) < 200:
        body = "".join(rng.choice(letters if len(pairs) % 2 else "abcdefghijklmnopqrstuvwxyz/_\t") for _ in range(60))
        heads = rng.sample(["", "#17.", "#9)", "(42)", "-"], 2)
        pair = tuple((h + body).strip() for h in heads)
        if shingle_similarity(*pair) >= 0.8:
            pairs.append(pair)
    assert found_pairs(spark, pairs) >= 0.97 * len(pairs)


def test_line_dedup_pairs_across_components(spark):
    """Many copies of one line that are not similar enough to each other: the last join makes few of all their pairs."""
    rng, letters = random.Random(17), "abcdefghijklmnopqrstuvwxyz"
    line = "".join(rng.choice(letters + "   ") for _ in range(300)).strip()
    near = lambda: "".join(rng.choice("0123456789") if rng.random() < 0.02 else c for c in line)
    lines = [near() for _ in range(150)] + [line[:150] + "".join(rng.choice(letters) for _ in range(150)) + "a" * 12]
    made, verified = [], line_dedup.verified

    def seen(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "verified", seen)
        gone = set(line_dedup.remove_lines(table(spark, ["\n".join(lines)])).first()["removed"])
    links = [(a, b) for a in range(len(lines)) for b in range(a) if shingle_similarity(lines[a], lines[b]) >= 0.8]
    roots = components_of(range(len(lines)), links)
    assert gone == {k for k, c in roots.items() if k != min(j for j, d in roots.items() if d == c)}
    assert len(made) < 3 or made[2] <= 600, made


def test_line_sketches_bound_the_similarity():
    rng = random.Random(18)
    lines = ["ab" * 20, "x" * 30, "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(3000))]
    for _ in range(60):
        lines.append("".join(rng.choice("abcdefg 0") if rng.random() < rng.choice([0.02, 0.1]) else c for c in rng.choice(lines)))
    out = next(line_dedup.sketches([pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array(lines)], ["id", "line"])])).to_pylist()
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    assert [r["n"] for r in out] == [len(x) for x in sets]
    for a in range(len(lines)):
        for b in range(a):
            differ = sum(((out[a][f"p{w}"] ^ out[b][f"p{w}"]) & (1 << 64) - 1).bit_count() for w in range(line_dedup.FOLD))
            assert differ <= len(sets[a] ^ sets[b])


# 4 ----------------------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    page = "<html lang='fr'><head><title>T &amp; t</title><script>x('</p>')</script></head><body><h1>Un</h1><!-- no --><p>deux&nbsp;&lt;trois&gt; <b>qua</b>tre<br>cinq <a href='/x?a=1&amp;b=2'>six</a><style>p{}</style></body></html>"
    rows = [("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nETag: e1\r\n\r\n" + page.encode()), (None, None, None, None), ("<urn:uuid:2>", "u", "d", b"no http \xff"), ("<urn:uuid:2>", "u", "d", b"no http \xff")]
    src = spark.createDataFrame(rows, "record_id string, target_uri string, date string, block binary").withColumn("headers", F.lit("clash"))
    got = warc.derivatives(src).collect()
    assert len(got) == 8
    meta, text = sorted((r for r in got if r["source_id"] == "<urn:uuid:1>"), key=lambda r: r["record_type"], reverse=True)
    assert bytes(text["content"]).decode() == "Un\ndeux <trois> quatre\ncinq six" and text["refers_to"] == "<urn:uuid:1>"
    assert b"title: T & t\r\n" in bytes(meta["content"]) and b"outlink: /x?a=1&b=2\r\n" in bytes(meta["content"]) and b"language: fr" in bytes(meta["content"])
    assert text["record_id"] in meta["headers"] and "X-Source-ETag: e1" in text["headers"] and text["payload_digest"] == warc.digest(page.encode())
    assert text["block_digest"] == warc.digest(bytes(text["content"])) and f"Content-Length: {len(text['content'])}" in text["headers"]
    assert {r["block_digest"] for r in got} and all(r["refers_to"] for r in got)
    files = warc.write_warc(warc.derivatives(src), str(tmp_path / "w")).collect()
    raw = b"".join(gzip.decompress(open(r["file"], "rb").read()) for r in files)
    assert raw.count(b"WARC/1.1\r\n") == sum(r["records"] for r in files) == 8
    assert warc.derivatives(src.where("false")).count() == 0


class Reader(HTMLParser):
    """The same text by the standard library's parser, one rule after another."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.skip, self.head, self.links, self.title, self.in_title = [], [], False, [], None, False

    def handle_starttag(self, tag, attrs):
        if self.skip:
            self.skip += [tag] if tag == self.skip[-1] else []
        elif tag in warc.SKIPPED | warc.RAW:
            self.skip.append(tag)
            self.out.append(" ")
        elif tag == "title":
            self.in_title = True
        elif tag == "head":
            self.head = True
        else:
            self.head = self.head and tag in warc.HEADED
            self.links += [v or "" for k, v in attrs if k == "href"][:1] if tag == "a" else []
            self.out += ["\n"] if tag in warc.BLOCKS else []

    def handle_startendtag(self, tag, attrs):
        if tag not in warc.SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skip:
            self.skip.pop() if tag == self.skip[-1] else None
        elif tag == "title":
            self.in_title = False
        elif tag == "head":
            self.head = False
        elif tag in warc.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
            return
        if self.skip:
            return
        self.head = self.head and not data.strip()
        self.out += [] if self.head else [data]

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def text(self):
        rows = (" ".join(r.split()) for r in html.unescape("".join(self.out)).split("\n"))
        return "\n".join(r for r in rows if r)


def random_page(rng):
    word = lambda: rng.choice(["eins", "zwei &amp; drei", "&lt;x&gt;", "a &#233; b", "caf\u00e9", "1 > 0", " ", "\n"])

    def node(depth):
        kind = rng.choice("ttttbbbiiascrkv")
        inner = "".join(node(depth + 1) for _ in range(rng.randrange(4))) if depth < 4 else word()
        if kind == "t":
            return word()
        if kind == "b":
            tag = rng.choice(["div", "p", "li", "td", "H1"])
            return f"<{tag} title='x > y' data-q=\"it's <b>\">{inner}</{tag}>"
        if kind == "i":
            tag = rng.choice(["b", "span", "i"])
            return f"<{tag}>{inner}</{tag} >"
        if kind == "a":
            return f"<a class=x href=\"/p?{rng.randrange(9)}\">{inner}</a>"
        if kind == "s":
            return f"<script>if (a < b) {{ x('</p>{rng.randrange(9)}') }}</script>"
        if kind == "c":
            return "<!-- <p>gone</p> -->"
        if kind == "r":
            return rng.choice(["<br>", "<br/>", "<img alt='>'>"])
        if kind == "k":
            return f"<noscript>{inner}</noscript>"
        return f"<svg><path d='M0'/>{word()}</svg>"

    head = "<head><meta charset=utf-8><title>T</title><style>p > a {}</style>" + rng.choice(["</head>", ""]) if rng.random() < 0.7 else ""
    return f"<!DOCTYPE html><html lang=en>{head}<body>{''.join(node(0) for _ in range(6))}</body></html>"


def test_pages_against_the_standard_parser():
    rng = random.Random(8)
    for _ in range(300):
        page = random_page(rng)
        mine, other = warc.Page(page), Reader()
        other.feed(page)
        other.close()
        assert mine.text() == other.text(), page
        assert mine.links == other.links and (mine.title or None) == other.title and mine.lang == "en", page


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<html ", "<script>", "<!--", "<", "<a '", '<p "\'', "<svg>", "</", "<a href=x "])
def test_hostile_pages_take_linear_time(piece):
    began = time.process_time()
    warc.Page(piece * (400_000 // len(piece))).text()
    assert time.process_time() - began < 3


def test_odd_pages():
    assert warc.plain_text("<head><title>t</title><p>no end of head</p>") == "no end of head"
    assert warc.plain_text('<p title="a>b">text</p> 1 < 2 <3') == "text\n1 < 2 <3"
    assert warc.plain_text("a<style>x") == "a" and warc.plain_text("a<b") == "a" and warc.plain_text("") == ""


def test_warc_input_and_encodings(spark, tmp_path):
    body = gzip.compress(b"<p>packed</p>")
    http = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\n" + b"".join(b"%x\r\n%s\r\n" % (len(body[k : k + 9]), body[k : k + 9]) for k in range(0, len(body), 9)) + b"0\r\n\r\n"
    record = lambda kind, block: b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:uuid:7>\r\nWARC-Target-URI: http://x/\r\nWARC-Date: 2024-02-02T00:00:00Z\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(block), block)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(b"warcinfo", b"x: y\r\n")) + gzip.compress(record(b"response", http)))
    (tmp_path / "b.warc").write_bytes(record(b"response", b""))
    got = warc.read_warc(spark, [str(tmp_path / "a.warc.gz"), str(tmp_path / "b.warc")])
    assert got.count() == 2
    text = [r for r in warc.derivatives(got).collect() if r["record_type"] == "conversion" and len(r["content"])]
    assert [bytes(r["content"]) for r in text] == [b"packed"] and text[0]["payload_digest"] == "sha1:ABC" and text[0]["refers_to"] == "<urn:uuid:7>"
    assert text[0]["headers"].count("X-Source-Set-Cookie: ") == 2 and "WARC-Date: 2024-02-02T00:00:00Z" in text[0]["headers"]


# 5 ----------------------------------------------------------------------------------------------------------------------


def test_pieces(spark):
    model = pieces.model_bytes()
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Pieces(model)
    rng = random.Random(6)
    texts = AWKWARD + [prose(rng, 50) for _ in range(30)] + ["".join(rng.choice("ab ▁\n1.,éÉ漢😀<>") for _ in range(60)) for _ in range(200)] + ["Hello World, the United States of America!" * 3]
    for t in texts:
        ids = lib.encode(t or "")
        assert own.encode(t or "") == ids and own.decode(ids) == lib.decode(ids)
        assert [i for p in own.split(t or "") for i in own.part_ids(p)] == ids
    ids = [rng.randrange(3, 32000) for _ in range(300)]
    assert own.decode(ids) == lib.decode(ids)
    got = {r["doc_id"]: r for r in pieces.encode_decode(table(spark, texts), model).collect()}
    for k, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert pieces.encode_decode(table(spark, []), model).count() == 0


# 6 ----------------------------------------------------------------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute_contamination(texts, items):
    out = []
    for t in texts:
        x, hit, found = words(t), set(), set()
        for item, text in items:
            y = words(text)
            for k in range(max(1, len(y) - 9) if y else 0):
                win = y[k : k + 10]
                for s in range(len(x) - len(win) + 1):
                    if x[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        found.add(str(item))
        out.append((len(x), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, n, 4)) for k, n in enumerate([30, 12, 10, 9, 2, 1, 0])] + [(20, None), (21, "A0 É1"), (22, prose(rng, 12, 4)), (23, "A0 É1")]
    texts = [prose(rng, 60, 4) for _ in range(20)] + [prose(rng, 5, 4) + " " + " ".join((items[rng.randrange(2)][1]).split()[rng.randrange(8) :]) + "! " + prose(rng, 5, 4) for _ in range(20)] + ["a0, é1 a0 É1", items[0][1].upper() * 2] + AWKWARD
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("pos", F.lit("clash"))
    got = {r["doc_id"]: r for r in decontaminate.contamination(table(spark, texts), bench).collect()}
    for k, want in enumerate(brute_contamination(texts, items)):
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
    docs = spark.createDataFrame([(None, "a0 É1"), (1, "a0 É1"), (1, "a0 É1"), (1, "none")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in decontaminate.contamination(docs, bench.where("item_id = 21")).collect()) == [(0, 2), (1, 0), (1, 2), (1, 2)]
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0


def test_proximity(spark):
    texts = ["a x x b", "a x x x b", "b a", "a", "b x a x c"]
    index = decontaminate.build_index(table(spark, texts))
    ask = spark.createDataFrame([("ab", ["a", "b"]), ("abc", ["a", "b", "c"]), ("a", ["a"])], "query string, terms array<string>").withColumn("terms", F.transform("terms", lambda t: F.xxhash64(t)))
    got = {(r["query"], r["doc_key"]) for r in decontaminate.proximity_matches(index, ask, 3).collect()}
    assert {x for x in got if x[0] == "ab"} == {("ab", 0), ("ab", 2), ("ab", 4)} and {x for x in got if x[0] == "a"} == {("a", k) for k in range(5)} and ("abc", 4) not in got


# 7 ----------------------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d)))) % 10 == 0


def base_spans(t):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t or "") if ok(k, m.group())]


def test_personal(spark):
    rng = random.Random(8)
    texts = ["a@b.c@d.e.f", "a@b.c.@d.e", "x..@-.- 1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "+1 (743) 555-3824 +1-2 ++12 34 5678", "001.002.0003.255 1.2.3.256", "😀é 1.2.3.4 a@b.co", "9" * 30000, "a" * 30000 + "@b.c", "1 " * 20000, "+" * 500 + "1 2 3 4 5 6 7 8"] + AWKWARD
    texts += ["".join(rng.choice("0123456789 .-+@ab()") for _ in range(120)) for _ in range(150)]
    got = {r["doc_id"]: r for r in personal.personal_data(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = base_spans(t)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:80]
        assert [got[k][f"n_{x}"] for x in BASE] == [sum(s.startswith(x) for s in want) for x in BASE]
        assert set(want) <= set(got[k]["spans"].split(",")) | {""}
    assert personal.personal_data(table(spark, [])).count() == 0


def test_contexts_of_seeds_discover_more(spark):
    texts = [f"please call phone number +1 555 0{k}0 2000 now" for k in range(8)] + ["please call phone  number 555-123-4567", "please call phone number 555-123-4567, now", "lot number 555-123-4567", "nothing"]
    docs = spark.createDataFrame([*enumerate(texts), (9, texts[9]), (None, texts[9])], "doc_id long, text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["spans"], r["n_added"]) for r in personal.personal_data(docs).collect())
    assert [g for g in got if g[2]] == [(-1, "phone:25:37", 1), (8, "phone:26:38", 1), (9, "phone:25:37", 1), (9, "phone:25:37", 1), (10, "phone:11:23", 1)]


def test_discovered_instances_induce_patterns_of_their_own(spark):
    """27 seeds vouch for a pattern, its six other numbers for a second pattern, and that one's last number, written with
    blanks and brackets, is found in the second round; numbers in mixed company are left alone."""
    own = [f"({k}55) 12{k} 456{k}" for k in range(1, 8)]
    texts = [f"call my office number +1 555 1{k:02d} 2000 today" for k in range(27)]
    texts += [f"call my office number {x} today" for x in own[:6]] + [f"the fax line {x} rings often" for x in own]
    texts += [f"part code 20{k}-30{k}-4000 in stock" for k in range(9)]
    got = {r["doc_id"]: r for r in personal.personal_data(table(spark, texts)).collect()}
    assert [k for k, r in sorted(got.items()) if r["n_added"]] == list(range(27, 40))
    assert got[39]["spans"] == "phone:13:27" and texts[39][13:27] == own[6]


# 8 ----------------------------------------------------------------------------------------------------------------------


def test_far_apart_pivots_separate_clusters():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(32, 64)))
    sample = unit(np.repeat(centres, 32, axis=0) + rng.normal(scale=0.01, size=(1024, 64)))
    radius = float(np.sqrt(2 - 2 * 0.95))
    first = vector_join.spread(sample, 32)
    assert len({int((centres @ v).argmax()) for v in first}) == 32, "the first pivots are one of each cluster"
    home, mask = vector_join.copies(sample, first, radius)
    sizes = np.bincount(home, minlength=32) + mask.sum(axis=0)
    assert (sizes.astype(float) ** 2).sum() < 0.1 * len(sample) ** 2, "cells compare few of all pairs"


def test_vector_links(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 16))
    near = base[rng.integers(0, 20, 150)] + rng.normal(size=(150, 16)) * rng.choice([0.02, 0.08, 0.12], size=(150, 1))
    x = [list(map(float, v)) for v in np.concatenate([base, near, near[:1].repeat(30, 0), near[1:2] * 3])]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0] * 3]
    rows = [(k, v, "clash") for k, v in enumerate(x + odd)]
    unit = np.asarray(x) / np.linalg.norm(x, axis=1)[:, None]
    near_by = unit @ unit.T >= 0.95
    np.fill_diagonal(near_by, False)
    want = components_of(range(len(rows)), zip(*map(list, np.nonzero(near_by)), strict=True))
    got = {r["vec_id"]: r for r in vector_join.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")).collect()}
    assert len(got) == len(rows)
    for k in range(len(rows)):
        links = int(near_by[k].sum()) if k < len(x) else 0
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (links, want[k], want[k] == k)
    assert vector_join.cosine_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_copies_cover_every_link():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(800, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    r = math.sqrt(0.1)
    home, mask = vector_join.copies(x, x[:20], r)
    for a, b in zip(*np.nonzero(x @ x.T >= 0.95), strict=True):
        if home[a] > home[b]:
            assert mask[a, home[b]]


# 9 ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype("<u4")
    data = token_pack.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (token_pack.unpack(data, bits, 1001) == ids).all()
    assert [token_pack.width(v) for v in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_token_files(spark, tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    lib = Tokenizer.from_str(model)
    rng = random.Random(11)
    texts = AWKWARD + ["It's IT'S we'LL ''' 'sample !'s ½ ²x 3a\xa0b\x85c µª ÀÉ \x1f_"] + [prose(rng, 40) for _ in range(40)]
    docs = table(spark, texts).repartition(3).union(table(spark, ["last"], -5))
    manifest = token_pack.write_tokens(docs, model, 1, f"{tmp_path}/ids", lib.get_vocab_size())
    got = {r["doc_id"]: r for r in token_pack.read_tokens(manifest).collect()}
    at = 0
    for k, t in sorted([(-5, "last"), *enumerate(texts)]):
        ids = np.asarray([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes())), t and t[:50]
        at += len(ids)
    row = manifest.orderBy("part").first()
    reader = token_pack.Reader(row["file"])
    everything = np.concatenate([i for _, i in reader.documents()])
    assert (reader.ids(5, len(everything) - 3) == everything[5:-3]).all() and len(reader.ids(4, 4)) == 0
    empty = token_pack.write_tokens(docs.where("false"), model, 1, f"{tmp_path}/none", 50000)
    assert token_pack.read_tokens(empty).count() == 0


# 10 ---------------------------------------------------------------------------------------------------------------------


def shingle_set(t, size=4):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def test_prefix_join(spark, monkeypatch):
    monkeypatch.setattr(prefix_join, "HOT_FROM", 8)
    rng = random.Random(12)
    base = [prose(rng, rng.choice([5, 30, 120, 400]), 500) for _ in range(25)]
    shared = prose(rng, 60, 500)
    texts = list(base) + [t.upper() for t in base[:5]] + AWKWARD + ["a b c", "A  b\tc", "a b"]
    for _ in range(120):
        w = rng.choice(base[:8]).split()
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
        texts.append(" ".join(w))
    texts += [prose(rng, 80, 500) + " " + shared for _ in range(30)]
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components_of(range(len(texts)), links)
    rows = table(spark, texts)
    got = {r["doc_id"]: r for r in prefix_join.linked_components(rows).collect()}
    assert len(got) == len(texts)
    for k in got:
        assert (got[k]["n_shingles"], got[k]["component_id"]) == (len(sets[k]), want[k])
    assert prefix_join.linked_components(rows.where("false")).count() == 0
    some = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (3, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in prefix_join.linked_components(some).collect()) == [(0, 0), (3, 3), (3, 3), (4, 3)]
