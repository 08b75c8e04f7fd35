"""WARC derivative builder: response records -> linked metadata and plain-text conversion records.

Each response gives one metadata record (application/warc-fields: title, language, status, counts, out-links) and one
conversion record (text/plain). Both name the response in WARC-Refers-To, repeat its target URI, date and payload digest
in headers, carry all HTTP headers of the source, in order and with repeats, in X-Source-* and have block digests of their
own. Record ids are derived from the response's id, so that a task that runs again builds the same records. A payload digest
that comes with the response is kept as it is; else it is taken of the payload as it was sent. read_warc() reads WARC files.

Text: comments, script, style, template, noscript, svg and head go; block elements and <br> break lines; other tags go; character
references are decoded; blanks collapse; empty lines go. Pages are scanned once from start to end, in time linear in their
length: a tag ends at the first > outside of quotes, one that never ends takes the rest with it, as in browsers; a head
ends at its end tag, at <body> or at the first element that cannot be in a head.

Defined cases: a null or empty block is a response without headers or payload and gives empty texts; bytes that are not
valid in the declared charset (UTF-8 if none is known) become U+FFFD; chunks are joined and gzip or deflate is undone before the
text is taken, and a body that does not keep to them is taken as it stands; a null uri gives empty headers; a null record id
is derived from uri and block; repeated rows give repeated records; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ship, stored, table
from .token_pack import opened

NAMESPACE = uuid.UUID("9f0c1d6e-7b5a-5c39-8a44-3d1b7f2a6c10")
SKIPPED = {"template", "noscript", "svg"}
RAW = {"script", "style"}
HEADED = {"title", "meta", "link", "base", "script", "style", "noscript", "template", "head", "html", "!", "?"}
BLOCKS = set("address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead tr ul".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
PLAIN = re.compile(r"[^>\"']*+")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
SCHEMA = "source_id string, record_type string, record_id string, refers_to string, target_uri string, headers string, content binary, block_digest string, payload_digest string"


class Page:
    """Text, title, language and links of an HTML page, in one scan."""

    def __init__(self, page: str):
        self.page, self.lower, self.parts = page, page.lower(), []
        if len(self.lower) != len(page):  # a letter whose lower case has another length
            self.lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
        self.title, self.lang, self.links, self.none = None, "", [], set()
        self.scan()

    def text(self) -> str:
        rows = (" ".join(r.split()) for r in html.unescape("".join(self.parts)).split("\n"))
        return "\n".join(r for r in rows if r)

    def find(self, what: str, at: int, lower: bool = False) -> int:
        """str.find that remembers what is nowhere behind, so that many searches in vain cost one."""
        if what in self.none:
            return -1
        found = (self.lower if lower else self.page).find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends at `at`; -1 if there is none."""
        while True:
            at = PLAIN.match(self.page, at).end()
            if at == len(self.page):
                return -1
            if self.page[at] == ">":
                return at
            close = self.find(self.page[at], at + 1)
            if close < 0:
                return self.find(">", at + 1) if ">" not in self.none else -1
            at = close + 1

    def close_of(self, name: str, at: int) -> int:
        """Where the end tag of a raw element starts; the end of the page if it has none."""
        found = self.find(f"</{name}", at, True)
        return len(self.page) if found < 0 else found

    def scan(self) -> None:
        page, at, head, skip = self.page, 0, False, []
        while at < len(page):
            start = self.find("<", at)
            if start < 0:
                start = len(page)
            if start > at and not skip:
                piece = page[at:start]
                head = head and not piece.strip()  # text ends a head
                if not head:
                    self.parts.append(piece)
            if start == len(page):
                return
            after = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                close = self.find("-->", start + 4)
                at = len(page) if close < 0 else close + 3
                continue
            if after in ("!", "?"):
                close = self.find(">", start + 1)
                at = len(page) if close < 0 else close + 1
                continue
            ends = after == "/"
            found = NAME.match(page, start + 1 + ends)
            if not found:  # a < that starts no tag
                if not skip and not head:
                    self.parts.append("<")
                at = start + 1
                continue
            name, close = found[0].lower(), self.tag_end(found.end())
            if close < 0:
                return
            inside, at = page[found.end() : close], close + 1
            if skip:
                if name == skip[-1]:
                    skip.pop() if ends else inside.endswith("/") or skip.append(name)
                elif name in RAW and not ends:
                    at = self.close_of(name, at)
                continue
            if name in SKIPPED and not ends and not inside.endswith("/"):
                skip.append(name)
                self.parts.append(" ")
                continue
            if name in RAW and not ends:
                at = self.close_of(name, at)
                self.parts.append(" ")
                continue
            if name == "title" and not ends:
                stop = self.close_of(name, at)
                if self.title is None:
                    self.title = html.unescape(page[at:stop])
                if not head:
                    self.parts.append(page[at:stop])
                at = stop
                continue
            if name == "head":
                head = not ends
                continue
            head = head and name in HEADED
            if name == "html" and not ends and not self.lang:
                self.lang = dict(self.attributes(inside)).get("lang", "")
            elif name == "a" and not ends:
                self.links += [v for k, v in self.attributes(inside) if k == "href"][:1]
            if name in BLOCKS:
                self.parts.append("\n")

    @staticmethod
    def attributes(inside: str) -> list[tuple[str, str]]:
        return [(k.lower(), html.unescape(a or b or c)) for k, a, b, c in ATTRIBUTE.findall(inside)]


def plain_text(page: str) -> str:
    return Page(page).text()


def decoded(payload: bytes, fields: dict[str, str]) -> bytes:
    """The payload without chunks and compression."""
    if "chunked" in fields.get("transfer-encoding", "").lower():
        out, at = [], 0
        while (line := payload.find(b"\r\n", at)) >= 0:
            try:
                size = int(payload[at:line].split(b";")[0], 16)
            except ValueError:
                return payload
            if not size:
                payload = b"".join(out)
                break
            out.append(payload[line + 2 : line + 2 + size])
            at = line + 4 + size
        else:
            return payload
    try:
        kind = fields.get("content-encoding", "").strip().lower()
        if kind in ("gzip", "x-gzip"):
            return gzip.decompress(payload)
        if kind == "deflate":
            return zlib.decompress(payload, 15 if payload[:1] == b"\x78" else -15)
    except (OSError, EOFError, zlib.error):
        pass
    return payload


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_response(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, c, v in (r.partition(":") for r in rest) if c], payload


def one_line(value: str) -> str:
    return " ".join(value.split())


def derive(source_id: str | None, uri: str | None, date: str | None, block: bytes | None, payload_digest: str | None = None) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    block, uri, date = block or b"", uri or "", date or ""
    source_id = source_id or f"<urn:uuid:{uuid.uuid5(NAMESPACE, uri + digest(block))}>"
    status, fields, payload = split_response(block)
    known = {k.lower(): v for k, v in fields}
    body = decoded(payload, known)
    named = CHARSET.search(known.get("content-type", ""))
    try:
        page = Page(body.decode(named[1] if named else "utf-8", "replace"))
    except LookupError:
        page = Page(body.decode("utf-8", "replace"))
    text = page.text()
    facts = [("http-status", status), ("title", page.title or ""), ("language", page.lang), ("text-chars", str(len(text))), ("text-words", str(len(text.split()))), ("outlinks", str(len(page.links))), *(("outlink", x) for x in page.links)]
    meta = "".join(f"{k}: {one_line(v)}\r\n" for k, v in facts).encode("utf-8", "replace")
    payload_digest, out = payload_digest or digest(payload), []
    for kind, mime, content in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        record = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{source_id} {kind}')}>"
        other = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{source_id} ' + ('conversion' if kind == 'metadata' else 'metadata'))}>"
        head = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source_id), ("WARC-Related-Record", other), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(content))]
        head += [(f"X-Source-{k}", v) for k, v in fields] + [("Content-Type", mime), ("Content-Length", str(len(content)))]
        out.append((source_id, kind, record, source_id, uri, "".join(f"{one_line(k)}: {one_line(v)}\r\n" for k, v in head), content, digest(content), payload_digest))
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """responses (record_id, target_uri, date, block and, if known, payload_digest) -> the derived records, two for each row."""
    ship(responses.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                out = [r for row in zip(*(c.to_pylist() for c in some.columns), strict=True) for r in derive(*row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "content" else pa.string()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names)

    known = [F.col("payload_digest").cast("string")] if "payload_digest" in responses.columns else []
    return responses.select("record_id", "target_uri", "date", F.col("block").cast("binary").alias("block"), *known).mapInArrow(run, SCHEMA)


def records_of(stream):
    """(headers as a list of pairs, block) of each record of an open WARC file, compressed or not."""
    start = stream.read(2)
    stream.seek(0)
    stream = gzip.GzipFile(fileobj=stream) if start == b"\x1f\x8b" else io.BufferedReader(stream)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        fields = []
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields.append((name.strip(), value.strip()))
        size = int({k.lower(): v for k, v in fields}.get("content-length", "0"))
        yield fields, stream.read(size)


def read_warc(spark: SparkSession, files: list[str]) -> DataFrame:
    """The response records of WARC files, a file in a task: record_id, target_uri, date, block, payload_digest, warc_headers."""
    ship(spark)
    schema = "record_id string, target_uri string, date string, block binary, payload_digest string, warc_headers string"

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, name = opened(file)
                with store.open_input_file(name) as stream:
                    for fields, block in records_of(stream):
                        known = {k.lower(): v for k, v in fields}
                        if known.get("warc-type") == "response":
                            row = [known.get("warc-record-id"), known.get("warc-target-uri"), known.get("warc-date"), block, known.get("warc-payload-digest"), "".join(f"{k}: {v}\r\n" for k, v in fields)]
                            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if k == 3 else pa.string()) for k, v in enumerate(row)], [x.split()[0] for x in schema.split(", ")])

    names = spark.createDataFrame([(f,) for f in files], "file string")
    return names.repartition(max(1, len(files)), "file").mapInArrow(run, schema)


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """Write records as gzip members of one .warc.gz file for each partition; returns the manifest (file, records, bytes)."""
    ship(records.sparkSession)

    def run(batches):
        task, out, n, size = TaskContext.get(), None, 0, 0
        for batch in batches:
            for headers, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    file = f"{path}/derived-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
                    store, name = opened(file)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(name, compression=None)
                member = gzip.compress(b"WARC/1.1\r\n" + headers.encode() + b"\r\n" + content + b"\r\n\r\n", mtime=0)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [file], "records": [n], "bytes": [size]})

    return stored(records.select("headers", "content").mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


def responses_of(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as WARC responses with HTTP headers."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    key = F.sha2(F.concat_ws(" ", F.col("page_id").cast("string"), "url"), 256)
    ident = F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(key, a, n), F.lit("-"))][:-1], F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", ident.alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.concat(head.cast("binary"), body).alias("block"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as responses; for each derived record its links, headers and digests."""
    got = derivatives(responses_of(table(spark, sf_dir, "pages")))
    return got.select("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", F.length("content").cast("long").alias("content_length"), F.sha2("headers", 256).alias("headers_sha256"), F.sha2("content", 256).alias("content_sha256"))
