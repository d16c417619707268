"""Byte-pair encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tracemill.llm import bpe  # noqa: E402

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
SPECIAL = ["<|startoftext|>", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|startoftext|>", "<|endof", "text|>", "<", "<<|endoftext|>'s"]
HARD = ["", " ", "\t\n\r\x0b\x0c", "\x1c a\x1d\x1e\x1f", "\x85  x", "I'll we've they're it's don't 'S 'T 'Ll I'D", "é ́a Ạ̊", "Σας ΟΔΟΣ İIıi ßẞ ǅ",
        "日本語のテキスト 한국어 ภาษาไทย עברית", "1234 ١٢٣ Ⅷ½ 3.14e-10", "🙂👩‍👩‍👧 \U0001F3F4\U000E0067", "\x00\x7f﻿�", "x" * 5000, "ab" * 3000, "!" * 999 + "a" * 999,
        "café CAFÉ naïve,,, ÀÉÎÕÜ?! ÿ÷×", "a,b;c d.e", "the the the", "l'été aujourd'hui"]


def texts(seed, n):
    r = random.Random(seed)
    signs = "abcdefgXYZ 0123  \n\t'.,!<|>éÉßñ́ 日語ΣŁ🙂"
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_decoding_as_in_the_library(name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), bpe.Bpe(path)
    library.no_truncation(), library.no_padding()
    assert own.by_words == (name == FILES[0])
    for text in HARD + SPECIAL + [" ".join(SPECIAL)] + texts(4, 3000):
        want = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert got.tolist() == want, text
        assert own.decode(got).decode() == library.decode(want, skip_special_tokens=False), text
    some = np.random.default_rng(2).integers(0, 49000, (200, 9))
    for ids in some:                                              # also sequences that no text has
        assert own.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_every_single_sign():
    path = public_tokenizers.path(FILES[0])
    library, own = Tokenizer.from_file(path), bpe.Bpe(path)
    signs = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x10000, 0x1F000, 7)]
    for at in range(0, len(signs), 50):
        for text in (" ".join(signs[at:at + 50]), "a".join(signs[at:at + 50])):
            assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_merges_by_rank_then_place_and_skips_stale_pairs():
    own = bpe.Bpe.__new__(bpe.Bpe)
    own.rank, own.made = {1 << 20 | 2: 0, 2 << 20 | 1: 1, 5 << 20 | 5: 2, 1 << 20 | 1: 3}, [5, 6, 7, 8]
    assert own.merged([1, 2, 1, 2, 1]) == [7, 1]                  # (1 2)(1 2) 1, then the two fives; (2 1) was stale
    assert own.merged([2, 1, 1, 1, 1]) == [6, 8, 1]               # equal ranks from the left
    assert own.merged([1]) == [1] and own.merged([]) == []


def test_coded_rows(spark):
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    values = [*enumerate(HARD + SPECIAL), (None, "no id"), (None, None), (3, "again"), (3, "again"), (99, "wörter " * 300_000), (100, "z" * 700_000)]
    docs = spark.createDataFrame([(i, t, "x", 1, [1]) for i, t in values], "doc_id long, text string, ids_sha256 string, n_tokens int, ids array<int>")
    want = []
    for i, t in values:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.coded(docs, path)
    key = str
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    back = bpe.decoded(bpe.coded(docs, path, give_ids=True), path).collect()
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in back) == sorted(w[3] for w in want)
    assert bpe.coded(docs.limit(0), path).collect() == []
    assert bpe.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), path).collect() == [(1, None), (2, "")]


def test_unknown_kinds_are_refused(tmp_path):
    import json
    spec = json.load(open(public_tokenizers.path(FILES[0])))
    spec["model"]["dropout"] = 0.1
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Bpe(str(tmp_path / "t.json"))
