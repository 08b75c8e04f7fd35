"""Token-ID output with fixed-width bit packing.

File layout (all integers little-endian), one file for each range of doc_id:

    magic 'AUTK' | u16 version | u16 bits | u32 ids in a block
    blocks, each of whole bytes: id k of a block occupies bits k*bits .. (k+1)*bits-1, lowest bit first
    index: u64 block offsets (one more than blocks) | i64 doc ids | u8 null flags of doc ids | u64 ids in each document
    trailer: u64 index offset | u64 documents | u64 ids | magic

Every block starts at a stored offset, so any slice of ids is read by fetching and unpacking only its blocks.

Defined cases: an empty table gives no files and an empty result; a null text is an empty one, which has the end id alone; a
null doc_id comes first; rows that repeat a doc_id are each written, in the order of the hashes of their texts; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Words, new_path, ship, stored, table, worker_cache

MAGIC, VERSION, BLOCK = b"AUTK", 1, 1 << 15
HEAD, TAIL = struct.Struct("<4sHHI"), struct.Struct("<QQQ4s")


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = ((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+://|\w+:/", path) else (fs.LocalFileSystem(), path)


class Writer:
    """Streams ids into one file; memory is bounded by a block and the index."""

    def __init__(self, path: str, bits: int, block: int = BLOCK):
        store, name = opened(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        self.out, self.bits, self.block = store.open_output_stream(name), bits, block
        self.out.write(HEAD.pack(MAGIC, VERSION, bits, block))
        self.at, self.offsets, self.docs, self.nulls, self.lengths = HEAD.size, [], [], [], []
        self.waiting, self.held, self.total = [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for k in range(0, whole, self.block):
            self.offsets.append(self.at)
            self.at += self.out.write(data := pack(ids[k : min(k + self.block, whole)], self.bits)) or len(data)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        index = self.at
        for x, kind in ((self.offsets + [self.at], "<u8"), (self.docs, "<i8"), (self.nulls, "u1"), (self.lengths, "<u8")):
            self.out.write(np.asarray(x, kind).tobytes())
        self.out.write(TAIL.pack(index, len(self.docs), self.total, MAGIC))
        self.out.close()


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, path: str):
        store, name = opened(path)
        self.file = store.open_input_file(name)
        magic, version, self.bits, self.block = HEAD.unpack(self._read(0, HEAD.size))
        index, n, self.total, end = TAIL.unpack(self._read(self.file.size() - TAIL.size, TAIL.size))
        if (magic, end, version) != (MAGIC, MAGIC, VERSION):
            raise ValueError(f"{path} is not a packed token file")
        blocks = -(-self.total // self.block)
        raw = self._read(index, self.file.size() - TAIL.size - index)
        cuts = np.cumsum([0, 8 * (blocks + 1), 8 * n, n, 8 * n])
        self.offsets, docs, nulls, self.lengths = (np.frombuffer(raw[cuts[k] : cuts[k + 1]], kind) for k, kind in enumerate(("<u8", "<i8", "u1", "<u8")))
        self.docs = [None if z else int(d) for d, z in zip(docs, nulls, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        first, last = start // self.block, -(-stop // self.block)
        if first >= last:
            return np.zeros(0, "<u4")
        raw = self._read(int(self.offsets[first]), int(self.offsets[last] - self.offsets[first]))
        at, parts = int(self.offsets[first]), []
        for k in range(first, last):
            count = min(self.block, self.total - k * self.block)
            parts.append(unpack(raw[int(self.offsets[k]) - at : int(self.offsets[k + 1]) - at], self.bits, count))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def documents(self, span: int = 256):
        """(doc id, ids) of each document in order, reading a bounded run of documents at a time."""
        for k in range(0, len(self.docs), span):
            base, some = self.starts[k], self.ids(int(self.starts[k]), int(self.starts[min(k + span, len(self.docs))]))
            for i in range(k, min(k + span, len(self.docs))):
                yield self.docs[i], some[self.starts[i] - base : self.starts[i + 1] - base]


LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
#: Texts of these characters alone: for them Unicode's composition changes nothing and lower-casing goes letter by letter.
PLAIN = re.compile(r"[\x00-\x1b\x20-\xff]*")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


#: The steps of the vocabulary that the short way does itself.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
}


def short_way(model: dict) -> bool:
    """Whether a tokenizer's own steps are those that Encoder does: lower case, then words that never merge."""
    first = ((model.get("pre_tokenizer") or {}).get("pretokenizers") or [None])[0]
    return model.get("normalizer") == STEPS["normalizer"] and first == STEPS["split"]


class Encoder:
    """The tokenizers library, asked once for each word.

    The vocabulary's pre-tokenizer cuts a text into words that never merge with each other, so the ids of a text are
    those of its words, joined. Texts with characters beyond Latin-1, unusual blanks or the strings of special tokens
    go to the library whole.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        # the short way cuts words as this vocabulary's own steps do; any other vocabulary goes to the library whole
        self.short = short_way(json.loads(model))
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = Words(self.whole)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.short or not PLAIN.fullmatch(text) or self.special and self.special.search(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))


def encoder(model: str) -> Encoder:
    """One for each Python worker; its cache of words outlives a task."""
    return worker_cache(("token_pack", zlib.crc32(model.encode())), lambda: Encoder(model))


def write_tokens(docs: DataFrame, model: str, end_id: int, path: str, vocabulary: int) -> DataFrame:
    """Encode docs (doc_id, text) and write their ids below path in ascending doc_id order.

    Returns the manifest, a written table: part, file, n_docs, n_ids, base (ids in all earlier files). A null text is
    an empty one; a null doc_id comes first; rows with one doc_id follow each other by the hash of their texts. A task
    that is run again writes another file, and only the attempt that Spark commits enters the manifest.
    """
    spark, bits = docs.sparkSession, width(vocabulary)
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def write(batches):
        task, out = TaskContext.get(), None
        mine = encoder(shared.value)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    file = f"{path}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
                    out = Writer(file, bits)
                out.add(doc_id, np.frombuffer(mine.encode(text) + end, "<u4"))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [file], "n_docs": [len(out.docs)], "n_ids": [out.total]})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    manifest = stored(dealt.mapInArrow(write, "part long, file string, n_docs long, n_ids long"), "manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                start, docs, starts, counts, sums = row["base"], [], [], [], []
                for doc_id, ids in Reader(row["file"]).documents():
                    docs.append(doc_id)
                    starts.append(start)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(max(1, manifest.count()), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    size = Tokenizer.from_str(model).get_vocab_size(with_added_tokens=True)
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), model, 1, new_path(spark, "tokens"), size))
