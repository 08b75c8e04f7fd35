"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes one symbol for each character, blanks written as U+2581. An agenda of adjacent symbol pairs, ordered by
the score of the piece that a pair would make and then by place, drives the merges. Characters outside the vocabulary
fall back to byte pieces. The agendas of many short parts of texts run side by side as rows of a numpy array of scores;
a long part has a heap of its own.

Where no piece of the vocabulary holds U+2581 behind another character, a merge never crosses the start of a word; an
ASCII character that no longer piece holds never merges at all. The text is cut there (the vocabulary is examined when
it is loaded; without the property the whole text is one part), and the result of each distinct part is kept in a
bounded cache of the Python worker. The sentencepiece library checks the ids and the decoding of every distinct part that
the agenda computed, and of one whole text in CHARS characters; a difference raises.

Defined cases: a null text is an empty one, which has no ids; each row gets a result of its own, also rows that repeat others
and those with a null doc_id; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import CACHE_BYTES, ship, table, worker_cache

BLANK = "▁"


class Pieces(dict):
    """Maps a part of a text to (its ids as comma-joined decimals, their count, the decoded bytes)."""

    MOST, SHORT, ROWS, CHARS = CACHE_BYTES // 320 // 2, 24, 8_192, 1_000_000

    def __init__(self, model: bytes):
        import sentencepiece

        self.old: dict = {}
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        if any(lib.is_unused(i) for i in plain):
            raise ValueError("unused pieces are not supported")
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: lib.get_score(i) for i in plain}
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if len(self.bytes) not in (0, 256):
            raise ValueError("byte pieces are incomplete")
        self.unknown = lib.unk_id()
        self.raw = [bytes([int(names[i][3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else names[i].replace(BLANK, " ").encode() for i in range(n)]
        longer = {c for i in plain if len(names[i]) > 1 for c in names[i]}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in longer)
        self.alone = next((chr(c) for c in range(33, 127) if chr(c) not in longer), None)
        if any(BLANK in names[i].lstrip(BLANK) for i in plain):
            self.parts = re.compile("(?s).+")
        elif alone:
            self.parts = re.compile(f"{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}]+|[{alone}]")
        else:
            self.parts = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        # symbols: the pieces and what other characters pieces are made of; pairs: (left, right) -> piece, as sorted keys
        self.symbols = {c: -1 for c in sorted({c for i in plain for c in names[i]})}
        self.symbols |= {names[i]: i for i in plain}
        spare = iter(range(n, n + len(self.symbols)))
        self.symbols = {k: next(spare) if v < 0 else v for k, v in self.symbols.items()}
        self.letters = np.full(0x110000, -1, np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.letters[ord(c)] = i
        self.base = n + len(self.symbols) + 1
        pairs = sorted((a * self.base + b, i) for i in plain for k in range(1, len(names[i])) if (a := self.symbols.get(names[i][:k])) is not None and (b := self.symbols.get(names[i][k:])) is not None)
        self.pair_keys, self.pair_ids = (np.array([p[c] for p in pairs] or [-1], kind) for c, kind in ((0, np.int64), (1, np.int32)))
        levels = {x: k for k, x in enumerate(sorted({lib.get_score(i) for i in range(n)}, reverse=True))}
        self.size, self.none, self.decimals = n, len(levels), [str(i) for i in range(n)]
        self.ranks = np.array([levels[lib.get_score(i)] for i in range(n)] + [self.none], np.int32)  # the last: no piece

    def merged(self, part: str) -> list[str]:
        """The pieces of a part, by the agenda."""
        scores, symbols = self.scores, list(part)
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        after[-1] = -1
        agenda = [(-scores[pair], k, pair) for k in range(len(symbols) - 1) if (pair := symbols[k] + symbols[k + 1]) in scores]
        heapq.heapify(agenda)
        while agenda:
            _, k, pair = heapq.heappop(agenda)
            j = after[k]
            if symbols[k] is None or j < 0 or len(symbols[k]) + len(symbols[j]) != len(pair) or symbols[k] + symbols[j] != pair:
                continue
            symbols[k], symbols[j], after[k] = pair, None, after[j]
            if (r := after[k]) >= 0:
                before[r] = k
                if (new := pair + symbols[r]) in scores:
                    heapq.heappush(agenda, (-scores[new], k, new))
            if (p := before[k]) >= 0 and (new := symbols[p] + pair) in scores:
                heapq.heappush(agenda, (-scores[new], p, new))
        return [s for s in symbols if s is not None]

    def part_ids(self, part: str) -> list[int]:
        out: list[int] = []
        for piece in self.merged(part):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair of symbols makes, and the rank of its score; the rank is `none` where there is none."""
        keys = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        made = np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ids[at], -1)
        return made, self.ranks[made]

    def side_by_side(self, parts: list[str]) -> list[list[int]]:
        """The ids of short parts: in each round every part takes the first of its best pairs off its agenda."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        n, width = len(parts), int(lengths.max()) + 2
        symbols = np.full((n, width), -2, np.int32)  # -2: beyond the end; -1: unknown to the vocabulary
        symbols[np.arange(width) < lengths[:, None]] = self.letters[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
        made, ranks = self.joined(symbols[:, :-1], symbols[:, 1:])
        out: list[list[int]] = [[]] * n
        where, each = np.arange(n), np.arange(n)
        while True:
            best = ranks.argmin(axis=1)
            go = ranks[each, best] < self.none
            if not go.all():
                over = ~go
                left = symbols[over]
                fine = ((left == -2) | (left >= 0) & (left < self.size)).all(axis=1)
                for k, row, count, well in zip(where[over].tolist(), left.tolist(), (left != -2).sum(axis=1).tolist(), fine.tolist(), strict=True):
                    out[k] = row[:count] if well else self.part_ids(parts[k])
                symbols, made, ranks, where, best = symbols[go], made[go], ranks[go], where[go], best[go]
                each = np.arange(len(where))
                if not len(where):
                    return out
            new, m = made[each, best], len(where)
            stay = np.ones(symbols.shape, bool)
            stay[each, best + 1] = False
            symbols = symbols[stay].reshape(m, -1)
            symbols[each, best] = new
            stay = np.ones(made.shape, bool)
            stay[each, best] = False
            made, ranks = made[stay].reshape(m, -1), ranks[stay].reshape(m, -1)
            made[each, best], ranks[each, best] = self.joined(new, symbols[each, best + 1])
            inner = best > 0
            rows, before = each[inner], best[inner] - 1
            made[rows, before], ranks[rows, before] = self.joined(symbols[rows, before], new[inner])

    def known(self, parts: set[str]) -> set[str]:
        """Of parts that the cache lacks, those that the older generation lacks as well; the others come back from there."""
        for part in parts & self.old.keys():
            self[part] = self.old[part]
        return parts - self.old.keys()

    def learn(self, parts: set[str]) -> None:
        """Puts the given parts into the cache."""
        new = sorted(parts, key=len)
        cut = next((k for k, p in enumerate(new) if len(p) > self.SHORT), len(new))
        for k in range(0, cut, self.ROWS):
            some = new[k : min(k + self.ROWS, cut)]
            for part, ids in zip(some, self.side_by_side(some), strict=True):
                self.keep(part, ids)
        for part in new[cut:]:
            self.keep(part, self.part_ids(part))

    def age(self) -> None:
        """Between texts: a full cache becomes the older generation."""
        if len(self) >= self.MOST:
            self.old = self.copy()
            self.clear()

    def keep(self, part: str, ids: list[int]) -> tuple[str, int, bytes]:
        self[part] = found = (",".join([self.decimals[i] for i in ids]), len(ids), b"".join([self.raw[i] for i in ids]))
        return found

    def split(self, text: str) -> list[str]:
        return self.parts.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def encode(self, text: str) -> list[int]:
        found = [i for part in self.split(text) for i in self.part_ids(part)]
        return found if self.bytes else [i for k, i in enumerate(found) if i != self.unknown or not k or found[k - 1] != i]

    def decode(self, ids: list[int]) -> str:
        """Joins pieces and bytes; the blank put before a text goes again; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.raw.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")

    def check(self, parts: list[str], text: str) -> None:
        """Compares parts that were learnt, and one whole text, with the library: ids and decoded texts. A part that does not
        start with the blank mark is encoded behind a character that never merges."""
        lead = ",".join(map(str, self.part_ids(BLANK) + self.part_ids(self.alone))) if self.alone else ""
        own, want, texts = [], [], []
        for part in parts:
            if part == BLANK:  # alone at the start of a text it is empty
                continue
            if part[0] == BLANK:
                own.append(part)
                texts.append(part[1:])
                want.append(self[part][0])
            elif self.alone:
                own.append(part)
                texts.append(self.alone + part)
                want.append(f"{lead},{self[part][0]}")
        found = self.library.encode(texts, num_threads=1)
        for part, ids, expected in zip(own, found, want, strict=True):
            if ",".join(map(str, ids)) != expected:
                raise AssertionError(f"sentencepiece encodes {part!r} in another way")
        for ids, decoded in zip(found, self.library.decode(found, num_threads=1) if found else [], strict=True):
            if decoded != self.decode(ids):
                raise AssertionError(f"sentencepiece decodes {ids} in another way")
        ids = self.library.encode(text)
        if ids != self.encode(text) or self.library.decode(ids) != self.decode(ids):
            raise AssertionError("sentencepiece encodes or decodes a text in another way")


def pieces(model: bytes) -> Pieces:
    return worker_cache(("pieces", zlib.crc32(model)), lambda: Pieces(model))


def encode_decode(docs: DataFrame, model: bytes) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, one row for each row; a null text is an empty one."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        mine = pieces(shared.value)
        if not mine.bytes:
            raise ValueError("the digest columns need a vocabulary with byte pieces")
        for batch in batches:
            counts, hashes, decoded, texts, held = [], [], [], [], 0
            for k in range(batch.num_rows):
                texts.append(batch.column(1)[k].as_py())
                held += len(texts[-1])
                if held < mine.CHARS and k < batch.num_rows - 1:
                    continue
                split = [mine.split(text) for text in texts]
                mine.age()
                new = mine.known({part for parts in split for part in parts if part not in mine})
                mine.learn(new)
                mine.check(list(new), next(filter(None, texts), ""))
                for parts in split:
                    found = list(map(mine.__getitem__, parts))
                    counts.append(sum([x[1] for x in found]))
                    hashes.append(hashlib.sha256(",".join([x[0] for x in found]).encode()).hexdigest())
                    data = b"".join([x[2] for x in found])
                    decoded.append(hashlib.sha256(data[1:] if data[:1] == b" " else data).hexdigest())
                texts, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def model_bytes() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), model_bytes())
