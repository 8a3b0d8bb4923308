"""Operator 6: best-fit decreasing packing of token sequences.

A document is its token ids and an end id. It is cut into full windows and a rest below one window. Pieces are dealt by hash (with a salt
of the row's place in its task, so that repeated rows part) to groups whose size is bounded by bytes of text, whatever the lengths of
documents. In a group, longest first, each piece goes to the tightest open window that holds it, found by a segment tree indexed by
remaining capacity; full windows come first there and are sequences of their own.

Null and empty texts hold the end id alone. Repeated rows are packed each for itself. An empty table gives no rows. Each token lies
in exactly one piece. doc_id may be null, and of any type; other columns are not read. A group leaves about one window partly filled, so
padding is a fixed small share at every size.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condenspark.llm.common import bound_batches, give_back

ROW_BYTES = 16
PIECES = "doc_id {id}, start long, length long, doc_tokens long, ids binary, salt long"
PACKED = "doc_id {id}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"

#: Chunks of these letters, digits and marks (the bar of special tokens is none of them) may be split into words before the tokenizer
#: sees them, if PROBES say so.
PLAIN = re.compile("[!-{}~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
WORDS = re.compile(f"'(?:[st]|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+", re.I)
PROBES = (
    *(chr(c) + w + chr(d) for c in range(33, 127) for d in range(33, 127, 4) for w in ("", "Ab") if 124 not in (c, d)), *(w + chr(c) + "a" for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7) for w in ("", "B", "9", "'")),
    "don't", "I'LL", "we've.", "it'S!", "x'Mas", "a'tis", "''t", "l'\u00e9t\u00e9,", "\u00c9COLE-No.12", "na\u00efve's", "a1b22c", "$3.50%", "(x)[y]{z}", "...", "--", "e.g.,", "http://a.b/c?d=e&f", "Stra\u00dfe;", "\u00fcber/\u00dcBER",
)


#: About the bytes of an entry of the cache.
ENTRY = 200


class ChunkCache(dict):
    """Blank-delimited chunk -> ids as little-endian 32-bit bytes, all from the tokenizer.

    The tokenizer must not join tokens across a blank; a chunk is then encoded alone, and most chunks repeat. A chunk of plain letters,
    digits and marks that isn't known is split into words, and the tokenizer's model gives their ids; how it sees each character is asked
    of its normaliser and pre-tokeniser. This way is taken only if it gives the whole tokenizer's ids for every probe; any other chunk,
    and one that may hold a special token, is encoded whole. The cache holds about ``most`` bytes: when half of that is new, what was
    not used since the last time goes."""

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.shown, self.splits = self.tokenizer.model, {}, True
        plain = [c for c in map(chr, [*range(33, 124), *range(125, 127), *range(0xC0, 0x100)]) if PLAIN.match(c)]
        for c in plain:
            normal = self.tokenizer.normalizer.normalize_str(c) if self.tokenizer.normalizer else c
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if self.tokenizer.pre_tokenizer else [(normal, None)]
            self.shown[ord(c)] = "".join(x for x, _ in found)
        self.folds = all(self.shown[ord(c)] == self.shown[ord(c.lower())] for c in plain)  # are upper and lower case one to it?
        self.forget()
        self.splits = all(self._alone(p) == self[p] for p in PROBES)
        self.parts = all(self._alone(f"{a} {b}") == self._alone(a) + self._alone(b) == self._alone(f"{a}\n{b}") for a, b in zip(PROBES, PROBES[1:], strict=False))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.old = {}
        self[""] = b""

    def _alone(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _ids(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.translate(self.shown))]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.pop(chunk, None)
        if found is None:
            if not self.splits or not (chunk.isprintable() and "|" not in chunk if chunk.isascii() else PLAIN.fullmatch(chunk)):
                found = self._alone(chunk)
            else:
                word = chunk.lower() if self.folds else chunk
                if word.isalpha():
                    found = self._ids(word) if word == chunk else self[word]
                elif word[:-1].isalpha() and not word[-1].isdigit():
                    found = self[word[:-1]] + self[word[-1]]
                elif len(words := WORDS.findall(word)) > 1:
                    found = b"".join(map(self.__getitem__, words))
                else:
                    found = self._ids(word)
        self[chunk] = found
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin and end. A chunk is looked up once for all texts."""
        texts = texts.fill_null("")
        if not self.parts:
            alone = [self._alone(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(alone), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in alone], dtype=np.int64)])
        if len(self) * ENTRY > self.most // 2:
            kept = dict(self)
            self.forget()
            self.old = kept
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        found = list(map(self.__getitem__, coded.dictionary.to_pylist()))
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, begin, which = np.frombuffer(b"".join(found), "<u4"), np.cumsum(length) - length, coded.indices.to_numpy()
        own = length[which]
        ends = np.concatenate([[0], np.cumsum(own)])
        at = np.repeat(begin[which] - ends[:-1], own) + np.arange(ends[-1])
        return ids[at], ends[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]


_caches: dict[str, ChunkCache] = {}


def pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, cache_bytes: int, slice_rows: int = 512) -> DataFrame:
    """Documents cut into pieces of at most one window; salt: the piece's place in its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _caches:
            _caches.clear()
            _caches[tokenizer_path] = ChunkCache(tokenizer_path, cache_bytes)
        cache, end, salt = _caches[tokenizer_path], np.asarray([end_id], "<u4").tobytes(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                own, out = [], {k: [] for k in ("start", "length", "doc_tokens", "ids")}
                ids, ends = cache.encode(part.column("text"))
                for row in range(part.num_rows):
                    raw = ids[ends[row] : ends[row + 1]].tobytes() + end
                    n = len(raw) // 4
                    for start in range(0, n, window):
                        own.append(row)
                        for k, v in zip(out, (start, min(window, n - start), n, raw[4 * start : 4 * (start + window)]), strict=True):
                            out[k].append(v)
                doc_id = part.column("doc_id").take(pa.array(own, pa.int64()))
                salts = pa.array(range(salt, salt + len(own)), pa.int64())
                salt += len(own)
                yield pa.RecordBatch.from_arrays([doc_id, *(pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()), salts], names=["doc_id", *out, "salt"])
        cache.forget()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()))


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each piece, and the number of windows. The tree's leaf r counts open windows with r tokens free."""
    leaves = 1 << window.bit_length()
    tree, open_at = [0] * (2 * leaves), [[] for _ in range(window + 1)]

    def add(r: int, by: int) -> None:
        i = r + leaves
        while i:
            tree[i] += by
            i >>= 1

    def tightest(r: int) -> int:
        """The least remaining capacity of at least r, or -1."""
        i = r + leaves
        if tree[i]:
            return r
        while i > 1:
            if i % 2 == 0 and tree[i + 1]:
                i += 1
                while i < leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - leaves
            i >>= 1
        return -1

    where, offset, n = [0] * len(lengths), [0] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        free = tightest(lengths[k])
        if free < 0:
            w, free, n = n, window, n + 1
        else:
            w = open_at[free].pop()
            add(free, -1)
        where[k], offset[k] = w, window - free
        if left := free - lengths[k]:
            open_at[left].append(w)
            add(left, 1)
    return where, offset, n


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, group_bytes: int = 1 << 20, cache_bytes: int = 96 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian 32-bit), sequence_id, offset.
    A group has about group_bytes of text (a document counts ROW_BYTES more), so its ids fit in a task: a token is at least one byte."""
    bound_batches(docs.sparkSession)
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_groups = max(1, ((size["bytes"] or 0) + ROW_BYTES * size["n"]) // group_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    group = F.pmod(F.xxhash64("doc_id", "start", F.crc32("ids"), "salt"), F.lit(n_groups))

    def fit(own: pa.Table) -> pa.Table:
        own = own.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("salt", "ascending")]) if pa.types.is_primitive(own.schema.field("doc_id").type) else own
        where, offset, _ = best_fit_decreasing(own.column("length").to_pylist(), window)
        ids = own.column("piece_group")[0].as_py() * (1 << 32) + np.asarray(where, np.int64)
        return own.drop_columns(["piece_group", "salt"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    cut = pieces(docs, tokenizer_path, window, end_id, cache_bytes)
    return cut.withColumn("piece_group", group).groupBy("piece_group").applyInArrow(fit, PACKED.format(id=kind))
