"""Byte-pair encoding of texts and decoding of ids, from a tokenizer's file.

A piece is a doubly linked list of symbols. A heap holds (rank, place) of every neighbouring pair that has a merge; the least
is taken, skipped if the pair at that place has changed since, and merged; the new symbol's two pairs enter the heap. So a
piece of n symbols takes n log n steps, however long it is. Equal ranks are merged from the left. Decoding concatenates the
vocabulary's strings in the way of the file's decoder.

Texts are cut into pieces by the file's own normaliser and splitter; their ids are kept in bounded caches by word and piece.
Where the normaliser and the splitter are those of ``BY_WORDS`` a text is encoded word by word.

A null text is empty: no ids and an empty decoded text. Texts are whole, however long; a task holds one text's ids. Repeated
rows and null ids stay as they are; an empty table gives no rows; columns that are not named take no part."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common

# The normaliser and the splitter of files whose texts can be encoded word by word.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
PLAIN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")        # the same splitter for a word of ASCII
LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%&$*#()]*)")  # a word of letters that no normaliser joins, then signs
PLACE = 40                # bits of a place in a heap entry
CACHE = 200_000           # words, and pieces, of one cache generation


def byte_signs() -> list[str]:
    """The sign that stands for each byte: printable Latin-1 signs for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # Early files leave these out: then there is no such thing in them.
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        decoder = (spec["decoder"] or {"type": None})["type"]
        if "merges" not in model or odd or decoder not in (None, "ByteLevel") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("not a plain byte-pair file")
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.by_words = all(spec[k] == v for k, v in BY_WORDS.items())
        vocabulary, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.ids_of = vocabulary
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        size = max([*vocabulary.values(), *self.added.values()]) + 1
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        strings = [""] * size
        for s, i in [*vocabulary.items(), *self.added.items()]:
            strings[i] = s
        signs = byte_signs()
        if decoder:
            back = {c: b for b, c in enumerate(signs)}
            special = set(self.added.values())
            self.strings = [s.encode() if i in special or not all(c in back for c in s) else bytes(back[c] for c in s) for i, s in enumerate(strings)]
            self.gap = b""
        else:
            self.strings, self.gap = [s.encode() for s in strings], b" "
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {vocabulary[a] << 20 | vocabulary[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocabulary[a + b] for a, b in pairs]
        self.inner = [vocabulary.get(c, -1) for c in signs]
        self.last = [vocabulary.get(c + self.suffix, -1) for c in signs]
        self.pieces = common.WordCache(self._pieces, CACHE)
        self.words = common.WordCache(self._words, CACHE)

    def merged(self, symbols: list[int]) -> list[int]:
        """Ids of one piece, given the ids of its signs."""
        n, rank, made = len(symbols), self.rank, self.made
        if n < 2:
            return symbols
        heap = [r << PLACE | i for i in range(n - 1) if (r := rank.get(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapify(heap)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while heap:
            entry = heappop(heap)
            r, i = entry >> PLACE, entry & (1 << PLACE) - 1
            j = after[i]
            if j < 0 or rank.get(symbols[i] << 20 | symbols[j]) != r:
                continue                                          # stale: a symbol of the pair is gone or has grown
            new = symbols[i] = made[r]
            symbols[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(new << 20 | symbols[k])) is not None:
                    heappush(heap, r << PLACE | i)
            h = before[i]
            if h >= 0 and (r := rank.get(symbols[h] << 20 | new)) is not None:
                heappush(heap, r << PLACE | h)
        return [s for s in symbols if s >= 0]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        inner, last = self.inner, self.last
        return common.packed([self.merged([*[inner[b] for b in p[:-1]], last[p[-1]]]) for p in pieces], self.kind)

    def _signs(self, piece: str) -> list[int]:
        """A piece in the splitter's signs; what the vocabulary lacks has no id."""
        found = [self.ids_of.get(c) for c in piece[:-1]] + [self.ids_of.get(piece[-1] + self.suffix)]
        return [i for i in found if i is not None]

    def _whole(self, text: str) -> bytes:
        """The general way: the file's normaliser and splitter around its added tokens."""
        out, at = [], 0
        for m in [*(self.cut.finditer(text) if self.cut else ()), None]:
            part = text[at:m.start() if m else len(text)]
            for piece, _ in self.split(self.normalise(part)) if part else ():
                out += self.merged(self._signs(piece))
            if m:
                out.append(self.added[m.group()])
                at = m.end()
        return np.array(out, self.kind).tobytes()

    def _words(self, words: list[bytes]) -> list[bytes]:
        cut, out, todo = [], [None] * len(words), []
        for i, w in enumerate(words):
            if b"<" in w:
                out[i] = self._whole(w.decode())
            elif w.isascii():
                todo.append((i, PLAIN.findall(w.lower())))
            else:
                text = w.decode("utf-8", "surrogatepass")
                m = LATIN.fullmatch(text)
                if m:
                    todo.append((i, [p for p in (m[1].lower().encode(), m[2].encode()) if p]))
                else:
                    out[i] = self._whole(text)
        for _, pieces in todo:
            cut += pieces
        ids, at = self.pieces.take(cut), 0
        for i, pieces in todo:
            out[i] = b"".join(ids[at:at + len(pieces)])
            at += len(pieces)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        raw = b"".join(self.words.take(common.words_of(text))) if self.by_words else self._whole(text)
        return np.frombuffer(raw, self.kind).astype("<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8."""
        text = self.gap.join(map(self.strings.__getitem__, ids.tolist()))
        return text if self.gap else text.decode("utf-8", "replace").encode()


_loaded: dict[str, Bpe] = {}


def bpe_for(path: str) -> Bpe:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _coded(path: str, give_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_for(path)
        for batch in batches:
            n, ids_sha, text_sha, lists = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if give_ids:
                    lists.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if give_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def coded(docs: DataFrame, tokenizer: str, give_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256 and, if asked for, ids."""
    rows = common.short_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(_coded(tokenizer, give_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * give_ids)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_for(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return run


def decoded(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids have a null text."""
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return common.short_batches(rows).mapInArrow(_decoded(tokenizer), "doc_id long, text string")
