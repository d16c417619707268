"""Quality rules with tokeniser fertility.

Base rules look at words, signs, repeated lines and repeated runs of words. A text that passes them is measured with a
public byte-fallback vocabulary: characters per token, share of byte tokens, and token entropy in bits. Each script has its bands; a text outside the band of its most frequent script is rejected.

Tokens are those of the words, each encoded on its own (the vocabulary does not join words). A null or empty text has no
words and fails the base rules. A script without a band of its own takes ``other``; texts without any letter are ``signs``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common

SYMBOLS = b"#*$%&|<>"
ASCII_SPACE = " \t\n\x0b\x0c\r"
RUN = 8
LEAST_WORDS = 20
REPEATED = 30             # percent of words in repeated runs

# The first code points of script blocks and their names.
SCRIPTS = [(0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
           (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
           (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]
STARTS = np.array([s for s, _ in SCRIPTS])

# Bands by script: characters per token (least, most), byte tokens (most), token entropy in bits (least). Latin: the 0.1 %
# percentiles over all documents of sf0.1 that pass the base rules (1.754 characters, 4.29 bits, no byte tokens) less 0.1 and
# 0.3. Other scripts have no documents there: their bands lie between a paragraph of prose and random letters of the script.
BANDS = {
    "latin": (1.65, 6.0, 0.05, 4.0),
    "greek": (0.75, 5.0, 0.08, 3.5),
    "cyrillic": (1.1, 6.0, 0.05, 3.5),
    "hebrew": (0.7, 4.0, 0.08, 3.2),
    "arabic": (0.75, 4.0, 0.09, 3.5),
    "devanagari": (0.55, 4.0, 0.40, 3.5),
    "indic": (0.34, 4.0, 0.88, 3.2),
    "thai": (0.65, 6.0, 0.35, 3.5),
    "hangul": (0.5, 4.0, 0.50, 3.5),
    "kana": (0.65, 4.0, 0.40, 3.5),
    "han": (0.5, 4.0, 0.50, 3.5),
    "signs": (1.35, 6.0, 0.05, 4.0),
    "other": (0.3, 6.0, 0.86, 3.2),
}


class Pieces:
    """The vocabulary with a bounded cache of words."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.cache = common.WordCache(self._encode, 300_000)

    def _encode(self, words: list[bytes]) -> list[bytes]:
        return common.packed(self.model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1), "<i4")

    def measure(self, words: list[bytes], n_chars: int) -> tuple[int, float, float, float]:
        """Tokens, characters per token, share of byte tokens, entropy of the tokens in bits."""
        ids = np.frombuffer(b"".join(self.cache.take(words)), np.int32)
        if not len(ids):
            return 0, 0.0, 0.0, 0.0
        p = np.unique(ids, return_counts=True)[1] / len(ids)
        return len(ids), n_chars / len(ids), float(self.is_byte[ids].mean()), float(-(p * np.log2(p)).sum())


_loaded: dict[str, Pieces] = {}


def pieces_for(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def script_of(text: str) -> str:
    """The script with the most letters; the first in table order among equals. Without a letter: signs."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points[(points >= 0x80) | ((points >= 65) & (points < 91)) | ((points >= 97) & (points < 123))]
    if not len(points):
        return "signs"
    seen = np.bincount(np.searchsorted(STARTS, points, side="right") - 1, minlength=len(SCRIPTS))
    totals: dict[str, int] = {}
    for (_, name), n in zip(SCRIPTS, seen.tolist(), strict=True):
        totals[name] = totals.get(name, 0) + n
    return max(totals, key=totals.get)


def repeated_words(h: np.ndarray, size: int = RUN) -> int:
    """Words inside runs of ``size`` words that stand twice or more in the text, the first included."""
    w = common.windows(h, size)
    if len(w) < 2:
        return 0
    _, back, n = np.unique(w, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[back] > 1)
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(ASCII_SPACE):
            n += line in seen
            seen.add(line)
    return n


COLUMNS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
           "script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double")


def _measured(path: str, bands: dict[str, tuple[float, float, float, float]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_for(path)
        for pdf, docs in common.chunks(frames):
            h, begin = common.hash_docs(docs)
            out = []
            for i, (doc, text, words) in enumerate(zip(pdf["doc"].tolist(), pdf["text"].tolist(), docs, strict=True)):
                text = text or ""
                n = len(words)
                chars = len(text) - sum(text.count(c) for c in ASCII_SPACE)
                raw = text.encode("utf-8", "surrogatepass")
                again = repeated_words(h[begin[i]:begin[i + 1]])
                failed = n < LEAST_WORDS or 100 * again > REPEATED * n
                script = script_of(text)
                tokens, per, share, entropy = pieces.measure(words, chars)
                low, high, most, least = bands.get(script, bands["other"])
                out.append((None if doc == 2 ** 63 - 1 else doc, n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), repeated_lines(text), again, failed,
                            not failed and low <= per <= high and share <= most and entropy >= least, script, tokens, per, share, entropy))
            res = pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])
            res["doc_id"] = res["doc_id"].astype("Int64")
            yield res
    return run


def measure(docs: DataFrame, vocabulary: str, bands: dict[str, tuple[float, float, float, float]] = BANDS) -> DataFrame:
    """One row a document row, in place: nothing is shuffled."""
    return common.rows_keyed(docs).select("doc", F.col("text")).mapInPandas(_measured(vocabulary, bands), COLUMNS)
