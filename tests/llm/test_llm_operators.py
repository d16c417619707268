"""The pipeline operators against direct versions on small tables: nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tracemill.llm import dac, decontam, fertility, jaccard, langid, licenses, mixing, quality, stages, substring, url_lists  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, tid string, size string"


def made_texts(seed: int = 5, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    vocabulary = ["der", "die", "the", "of", "État", "naïve", "x.y", "A1", "loop", "Zeit", "日本", "tion", "ing", "ab!", "%%%"] + [f"w{i}" for i in range(80)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 90))) for _ in range(n // 3)]
    out: list[str | None] = [None, "", "  \n\t ", "one", "two words", "Released under the MIT License."]
    for t in base:
        out += [t, t]                                             # exact copies
        w = t.split(" ")
        if len(w) > 40:
            w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))                               # near copies
    out += ["hub " * 400 + base[0], base[1] + "\n" + base[1], " ".join(base[:6]) * 4]
    return out


@pytest.fixture(scope="module")
def texts():
    return made_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, ["en", "de", None][i % 3], [None, "b", "a"][i % 3], 1, 7, "tid", "size") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return {r[0]: tuple(r)[1:] for r in df.select(*cols).collect()}


def removed(texts, size):
    first, want = set(), {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = set()
        for a in range(len(w) - size + 1):
            k = tuple(w[a:a + size])
            if k in first:
                gone.update(range(a, a + size))
            first.add(k)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return want


def test_substring_dedup(docs, texts):
    assert rows(substring.dedup(docs, 20), "doc_id", "n_words", "n_removed", "kept_sha256") == removed(texts, 20)


def test_substring_dedup_with_a_crowded_sketch(docs, texts, monkeypatch):
    """A sketch that takes every window for repeated changes nothing."""
    monkeypatch.setattr(substring, "_slots", lambda h1, h2, bits: [h1.astype(np.int64) & 1] * substring.ROWS)
    assert rows(substring.dedup(docs, 20), "doc_id", "n_words", "n_removed", "kept_sha256") == removed(texts, 20)


def test_substring_gaps():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 20, 5000))
    assert (substring.unpack_gaps(substring.pack_gaps(x)) == x).all()
    assert substring.unpack_gaps(substring.pack_gaps(np.array([3, 3, 700, 700]))).tolist() == [3, 3, 700, 700]


def test_repeated_rows_are_one_document(spark):
    t = " ".join(f"v{i}" for i in range(30))
    twice = spark.createDataFrame([(1, t), (1, t), (None, t), (1, t + " end")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.dedup(twice, 20).collect())
    # of the two texts with id 1 one comes first by its hash; the equal rows fare alike
    assert got[0] == (-1, 30, 30) and got[1:] in ([(1, 30, 0), (1, 30, 0), (1, 31, 30)], [(1, 30, 30), (1, 30, 30), (1, 31, 0)])


def components(texts, num=90):
    sets = []
    for t in texts:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i:i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in range(len(sets))}


def test_jaccard_join(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 4)                      # many groups: links cross them
    assert rows(jaccard.join(docs), "doc_id", "n_shingles", "component_id") == components(texts)


def test_bitmap_bound_loses_no_link():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2 ** 64, int(rng.integers(1, 900)), dtype=np.uint64)
        for _ in range(4):
            kept = base[rng.random(len(base)) > rng.random() * 0.12]
            more = rng.integers(0, 2 ** 64, int(len(base) * rng.random() * 0.08), dtype=np.uint64)
            sets.append(np.unique(np.concatenate((kept, more))))
    sets = [s for s in sets if len(s)]
    group = pd.DataFrame({"d1": range(len(sets)), "d2": 0, "c1": range(len(sets)), "c2": 0, "gid": 1, "part": 0, "member": rng.random(len(sets)) > 0.4, "n": [len(s) for s in sets],
                          "bits": [jaccard.bitmap(s).tobytes() for s in sets]})
    kept = set(jaccard._possible(9, 10)(group)["d1"])
    linked = set()
    for a in range(len(sets)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 10 * shared >= 9 * (len(sets[a]) + len(sets[b]) - shared) and (group["member"][a] or group["member"][b]):
                linked |= {a, b}
    assert linked and linked <= kept and len(kept) < len(sets) / 2
    assert jaccard._possible(9, 10)(group[:0]).empty


def test_jaccard_chain(spark):
    """A long chain of near copies is one component, though its ends differ."""
    r = random.Random(1)
    w, chain = [f"c{i}" for i in range(120)], []
    for i in range(24):
        chain.append(" ".join(w))
        w = list(w)
        w[(5 * i) % 120] = f"n{r.random()}"
    ids = list(range(24))
    r.shuffle(ids)
    got = rows(jaccard.join(spark.createDataFrame(list(zip(ids, chain, strict=True)), "doc_id long, text string")), "doc_id", "component_id")
    want = components([chain[ids.index(i)] for i in range(24)])
    assert got == {i: (want[i][1],) for i in range(24)} and {v for (v,) in got.values()} == {0}


def test_jaccard_family_rows_stay_in_proportion(spark, monkeypatch):
    """A family of near copies that all differ: rows sent grow as the family, no group gets more than its part of them."""
    monkeypatch.setattr(jaccard, "GROUP", 8)
    saved, tables = jaccard.common.saved, defaultdict(list)
    monkeypatch.setattr(jaccard.common, "saved", lambda df, name: tables[name].append(saved(df, name)) or tables[name][-1])
    r, words, most = random.Random(4), [f"f{i}" for i in range(200)], {}
    for n in (300, 600):
        tables.clear()
        family = [" ".join(words[:(at := r.randrange(200))] + [f"x{i}"] + words[at + 1:]) for i in range(n)]
        got = jaccard.join(spark.createDataFrame(list(enumerate(family)), "doc_id long, text string"))
        assert {x.component_id for x in got.collect()} == {0}
        sizes = [x["count"] for t in tables["stops"] for x in t.groupBy("gid", "part").count().collect()]
        most[n] = max(sizes), sum(sizes)
    assert most[600][0] <= 8 * jaccard.GROUP and most[600][1] < 2.6 * most[300][1]


def test_jaccard_families_that_touch(spark, monkeypatch):
    """Against brute force: families that share most words, so that columns hold several components after the hubs."""
    monkeypatch.setattr(jaccard, "GROUP", 3)
    saved, tables = jaccard.common.saved, defaultdict(list)
    monkeypatch.setattr(jaccard.common, "saved", lambda df, name: tables[name].append(saved(df, name)) or tables[name][-1])
    r, words, texts = random.Random(8), [f"t{i}" for i in range(80)], []
    for _ in range(12):
        base = [f"u{r.random()}" if r.random() < 0.03 else w for w in words]
        for _ in range(14):
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(80)] = f"v{r.randrange(40)}"
            texts.append(" ".join(w))
    got = rows(jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == components(texts) and len({c for _, c in got.values()}) > 3
    assert tables["rest"][0].count() > 0 and len(tables["links"]) == 2 and not tables["links"][1].isEmpty()


def test_distinct_stage_keeps_one(spark, docs, texts):
    kept = stages.distinct(spark, docs, "")
    want = components(texts)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (n, c) in want.items() if c == i)


def test_distinct_stage_with_null_and_repeated_ids(spark):
    """Unlike texts stay although their ids are null or repeated; near copies go whatever their ids."""
    long = [" ".join(f"{c}{i}" for i in range(80)) for c in "abcdef"]
    near = {c: " ".join(f"{c}{i}" for i in range(79)) + f" {c}end" for c in "ad"}
    rows_in = [(None, long[0]), (None, long[1]), (None, near["a"]), (7, long[2]), (7, long[3]), (8, near["d"]), (7, long[4]), (7, long[4]), (None, long[5]), (None, None), (7, None), (7, "")]
    got = [tuple(r) for r in stages.distinct(spark, spark.createDataFrame(rows_in, "doc_id long, text string"), "").collect()]
    assert {t for _, t in got} >= {long[1], long[2], long[3], long[4], long[5]} and len(got) == 9
    assert sum(t in (long[0], near["a"]) for _, t in got) == 1 and (8, near["d"]) not in got and {(None, None), (7, None), (7, "")} <= set(got)


def test_distinct_stage_takes_five_words_and_four_fifths(spark, monkeypatch):
    """Against brute force, with copies on both sides of the threshold; some link at 0.8 that do not with three words and 0.9."""
    monkeypatch.setattr(jaccard, "GROUP", 4)
    r, texts = random.Random(9), []
    for b in range(6):
        w = [f"{'abcdef'[b]}{i}" for i in range(150)]
        texts.append(" ".join(w))
        for more in (12, 25, 36, 45):
            texts.append(" ".join(w + [f"x{r.random()}" for _ in range(more)]))
        for changed in (2, 3, 9):
            at = set(r.sample(range(150), changed))
            texts.append(" ".join(f"y{r.random()}" if i in at else x for i, x in enumerate(w)))
    sets, up = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    want = sorted(set(up))
    kept = sorted(x.doc_id for x in stages.distinct(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect())
    assert kept == want and want != sorted(i for i, (_, c) in components(texts).items() if c == i)


def test_jaccard_join_keeps_links_of_a_shared_id_apart(spark):
    """Two classes with the smallest id 7: the links of the one are not those of the other."""
    long = {c: " ".join(f"{c}{i}" for i in range(80)) for c in "ab"}
    near = {c: t + f" {c}end" for c, t in long.items()}
    df = spark.createDataFrame([(7, long["a"]), (7, long["b"]), (3, near["a"]), (9, near["b"])], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in jaccard.join(df).collect())
    assert got == [(3, 3), (7, 3), (7, 7), (9, 7)]


def test_decontamination(spark, docs, texts):
    base = [t for t in texts if t and len(t.split()) > 30]
    bench = [(1, " ".join(base[0].split()[5:25])), (10, " ".join(base[3].split()[:13])), (2, "x"), (3, None), (4, ""), (5, "two WORDS"), (1, base[0][:40]), (None, "changed")]
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def low(t):
        return words.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    wins = defaultdict(set)
    for i, t in bench:
        w = low(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[a:a + n])].add("" if i is None else str(i))
    want = {}
    for i, t in enumerate(texts):
        w, hit, items = low(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in wins:
                    hit.update(range(a, a + k))
                    items |= wins[tuple(w[a:a + k])]
        want[i] = (len(w), len(hit), sorted(items), len(hit) > 0 and 20 * len(hit) >= len(w))
    got = rows(decontam.contamination(docs, spark.createDataFrame(bench, "item_id long, text string")), "doc_id", "n_words", "n_hit", "items", "contaminated")
    assert got == want and any(x[3] for x in want.values()) and not all(x[3] for x in want.values())
    empty = decontam.contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert not any(r.contaminated for r in empty.collect()) and empty.count() == len(texts)


def seats(votes, n):
    got = [0] * len(votes)
    for _ in range(n):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_apportionment_by_highest_quotients(spark):
    r = random.Random(3)
    for n in (0, 1, 7, 100, 333):
        votes = [r.randint(1, 10_000) for _ in range(9)]
        df = spark.createDataFrame([(0, f"{i}", v, n) for i, v in enumerate(votes)], "g int, p string, v long, n long")
        got = {x.p: x.got for x in mixing.apportion(df, ["g", "p"], ["g"], "v", "n", "got").collect()}
        assert [got[f"{i}"] for i in range(9)] == seats(votes, n)


def levelled(sizes, weights, total=1.5, most=2.0):
    target, fixed = {}, set()
    whole = total * sum(sizes.values())
    while True:
        left = whole - sum(most * sizes[s] for s in fixed)
        free = [s for s in sizes if s not in fixed]
        target = {s: most * sizes[s] if s in fixed else left * weights[s] / sum(weights[x] for x in free) for s in sizes}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        fixed |= over


def test_mixing(spark, docs, texts):
    sizes = Counter()
    for i, t in enumerate(texts):
        sizes[[None, "b", "a"][i % 3]] += len(WORD.findall(t or ""))
    want = levelled(sizes, {"a": 5, "b": 2, None: 1})
    plan = {r.doc_id: r for r in mixing.plan(docs).collect()}
    taken = Counter()
    for i, t in enumerate(texts):
        s = [None, "b", "a"][i % 3]
        r = plan[i]
        assert (r["size"], r.source_size) == (len(WORD.findall(t or "")), sizes[s]) and r.target == pytest.approx(want[s]) and r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK
    again = {r.doc_id: r.taken for r in mixing.plan(docs.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in plan.items()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == Counter({i: r.taken for i, r in plan.items() if r.taken})


def test_token_codes_round_trip():
    r = np.random.default_rng(2)
    ids = np.concatenate((r.integers(0, 1024, 3000), r.integers(0, 60_000, 2000), [0, 2 ** 32 - 1]))
    r.shuffle(ids)
    parts = dac.encode(ids)
    assert (dac.access(*parts, 0, len(ids)) == ids).all()
    for a, b in [(0, 1), (511, 514), (1024, 1024), (4000, 4700), (len(ids) - 1, len(ids))]:
        assert (dac.access(*parts, a, b) == ids[a:b]).all()
    assert dac.access(*dac.encode(np.zeros(0, np.uint32)), 0, 0).tolist() == []


def test_token_output(docs, texts, monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(dac, "SEGMENT", 500)
    path = public_tokenizers.path("word_bpe_49k.json")
    t, at, want = Tokenizer.from_file(path), 0, {}
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert rows(dac.write_and_read(docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_words_alone_give_the_ids_of_the_text():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    t, own, r = Tokenizer.from_file(path), dac.Tokens(path), random.Random(4)
    signs = "abcXYZéÉßÿÀœŒİıſ'’s.,!?<>|;:%&$*#0159 \t\ńΣςΟ日한🙂-_ ≠"
    for x in ["<|endoftext|> a <|ENDOFTEXT|> it's. IT'S!", *["".join(r.choice(signs) for _ in range(30)) for _ in range(1500)]]:
        assert np.frombuffer(own.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_fertility(docs, texts):
    got = {r.doc_id: r for r in fertility.measure(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        runs = Counter(tuple(w[a:a + 8]) for a in range(len(w) - 7))
        inside = {j for a in range(len(w) - 7) if runs[tuple(w[a:a + 8])] > 1 for j in range(a, a + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        again = sum(x in lines[:j] for j, x in enumerate(lines))
        r, failed = got[i], len(w) < 20 or 100 * len(inside) > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), again, len(inside), failed)
        assert not (failed and r.kept)


def test_fertility_bands(spark):
    plain = " ".join(["The weather in the northern hills was mild and the farmers met near an old stone bridge to trade seeds for tools"] * 1)
    odd = " ".join(chr(0x10300 + i % 30) + chr(0x1F300 + i) for i in range(40))
    same = "a " * 7 + " ".join(f"a b c d e f g{i}" for i in range(1))
    df = spark.createDataFrame([(1, plain), (2, odd), (3, same)], "doc_id long, text string")
    got = {r.doc_id: r for r in fertility.measure(df, public_tokenizers.path("piece_bpe_32k.model"), {"latin": (1.3, 7.0, 0.1, 3.0), "other": (0.2, 8.0, 0.5, 1.5)}).collect()}
    assert got[1].kept and got[1].script == "latin" and got[1].byte_share == 0
    assert not got[2].kept and got[2].byte_share > 0.5 and not got[3].kept


def test_fertility_bands_reject_garbage(spark):
    """BANDS themselves: random letters, digits, signs and byte fallback go, prose stays."""
    r = random.Random(3)
    bad = [" ".join("".join(r.choice(signs) for _ in range(7)) for _ in range(300)) for signs in (
        "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef", "#*$%&|<>=+-_/", *[[chr(c) for c in range(a, b)] for a, b in (
            (0x10330, 0x1034B), (0x0900, 0x0980), (0x0E01, 0x0E5B), (0xAC00, 0xD7A4), (0x4E00, 0x9FA5), (0x0391, 0x03CA), (0x0410, 0x0450), (0x0621, 0x064B), (0x3041, 0x3097))])]
    bad.append(" ".join(chr(0x10300 + i % 30) + chr(0x1F300 + i) for i in range(40)))
    good = ["The weather in the northern hills was mild and the farmers met near an old stone bridge to trade seeds for tools",
            "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
            "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
            "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다."]
    df = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string")
    got = {x.doc_id: x for x in fertility.measure(df, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert not any(x.base_failed for x in got.values())
    assert [i for i, x in got.items() if x.kept] == list(range(len(bad), len(bad) + len(good)))
    assert got[1].script == "signs"


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in found if r.held_out and r.lang]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.9
    assert all(0 <= r.score <= 1 for r in found)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 !!", "de"), (4, "plain words", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd).collect()}
    assert (got[1], got[2], got[3]) == ("und", "und", "und")


def test_language_dictionaries_look_past_a_shared_heading(spark):
    df = spark.createDataFrame([(i, "shared heading " * 100 + " ".join(f"{'abcdefghij'[i % 10]}body" for _ in range(2000)), "en") for i in range(20)], "doc_id long, text string, lang string")
    found = langid.dictionaries(df)["en"]
    assert len(found) <= langid.DICT_BYTES and found.count(b"body") > found.count(b"heading") and langid.dictionaries(df.repartition(5))["en"] == found


def test_quality_classifier(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet".replace("0.001", "0.01")), spark.read.parquet(f"{sf}/labels.parquet".replace("0.001", "0.01"))
    learn, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    scored = quality.score(docs, quality.trained(docs, learn)).join(held, "doc_id").collect()
    good, toxic = [r for r in scored if r.quality and not r.toxic], [r for r in scored if r.toxic]
    assert sum(r.kept for r in good) / len(good) >= 0.85
    assert sum(r.expected_grade for r in good) / len(good) > sum(r.expected_grade for r in toxic) / len(toxic) + 0.4
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in scored)


def test_quality_edges(spark, docs, none):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality.select(docs, nothing).collect()} == set(range(3, docs.count()))
    odd = spark.createDataFrame([(i, [1, 0, None][i % 3], [0, 1, 0][i % 3]) for i in range(40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.trained(docs, odd)).collect()
    assert len(got) == docs.count() and not any(r.kept for r in got if r.doc_id < 3)
    assert quality.select(none, nothing).columns == none.columns


def test_licenses(spark, docs, texts):
    t = spark.createDataFrame(licenses.NOTICES + [("none", None), ("empty", "")], "license string, text string")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([
        (1000, "x y z this work is LICENSED under the gnu general public license version 3 or so"), (1001, "this work is licensed under the gnu general public permit"),
        (1002, "Licensed under the Apache License, Version 2.0. " * 3), (1003, "work is licensed under the GNU General Public License, version 3")], "doc_id long, text string"))
    got = rows(licenses.licensed(more, t), "doc_id", "licenses", "n_windows", "first_start")
    assert got[1000] == ("GPL-3.0", 3, 2) and got[1001][0] == "" and got[1002][0] == "Apache-2.0" and got[5] == ("MIT", 1, 0)
    assert got[1003] == ("", 0, None) or got[1003][0] == "GPL-3.0"
    assert len(got) == len(texts) + 4


def test_licence_bodies_whole_and_in_part(spark):
    """Every window with at least 0.8 of a text or header, against brute force over the registered templates."""
    plain = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    known = [(name, plain.findall(t.lower())) for name, t in licenses.NOTICES + licenses.TEXTS]
    bodies = [(name, t.split()) for name, t in licenses.TEXTS]
    texts = ["Copyright someone\n" + " ".join(w) + " and code" for _, w in bodies]
    texts += [" ".join(w[:int(len(w) * part)]) + " other words follow here" for _, w in bodies[:6] for part in (0.7, 0.88)]
    texts += [" ".join("changed" if i == len(w) // 2 else x for i, x in enumerate(w)) for _, w in bodies[:6]]

    def grams(w):
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    want = {}
    for d, t in enumerate(texts):
        w, hits = plain.findall(t.lower()), set()
        for name, k in known:
            hits |= {(name, a, len(k)) for a in range(len(w) - len(k) + 1) if 5 * len(grams(w[a:a + len(k)]) & grams(k)) >= 4 * len(grams(k))}
        want[d] = (",".join(sorted({h[0] for h in hits})), len(hits), min((h[1] for h in hits), default=None))
    got = rows(licenses.licensed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licenses.notices(spark)), "doc_id", "licenses", "n_windows", "first_start")
    assert got == want
    assert all(want[d][0] == name for d, (name, _) in enumerate(bodies)) and not all(x[1] for x in want.values())


def test_url_lists(spark):
    pages = spark.createDataFrame([
        (1, "https://u@a.bad.example.com:80/x/Y?q", 10), (2, "http://bad.example.com/x", 20), (3, "http://a.bad.example.com/x/Yes", 30), (4, None, 5), (5, "no url", 5),
        (6, "http://A.Bad.Example.com", None), (7, "http://ok.org/x/Y", 10), (2, "http://bad.example.com/x", 20)], "page_id long, url string, day int")
    entries = spark.createDataFrame([
        ("spam", "domain", "Bad.example.com", "add", 5), ("spam", "domain", "bad.example.com", "remove", 25), ("spam", "domain", "bad.example.com", "add", 7),
        ("phishing", "prefix", "a.bad.example.com/x/Y", "add", 10), ("allow", "host", "bad.example.com", "add", 20), ("allow", "host", "bad.example.com", "remove", 21),
        ("x", "host", "ok.org", "remove", 1), ("y", "host", "ok.org", "add", 10), ("y", "host", "ok.org", "remove", 10), (None, "host", "ok.org", "add", 1)],
        "list string, kind string, value string, action string, day int")
    got = sorted(tuple(r) for r in url_lists.filtered(pages, entries).select("page_id", "n_active", "lists", "first_since", "blocked").collect())
    assert got == [(1, 2, "phishing,spam", 5, True), (2, 2, "allow,spam", 5, False), (2, 2, "allow,spam", 5, False), (3, 0, "", None, False), (4, 0, "", None, False),
                   (5, 0, "", None, False), (6, 0, "", None, False), (7, 0, "", None, False)]


def test_url_lists_one_id_captured_often(spark):
    """Captures of one id on other days or with other urls have the entries of their own day and url; so do null ids."""
    bad, ok = "http://bad.org/x", "http://ok.org/x"
    pages = spark.createDataFrame([(1, bad, 10), (1, bad, 30), (2, bad, 10), (2, ok, 10), (None, bad, 10), (None, bad, 30), (3, None, 10), (3, bad, 10)], "page_id long, url string, day int")
    entries = spark.createDataFrame([("spam", "host", "bad.org", "add", 5), ("spam", "host", "bad.org", "remove", 20)], "list string, kind string, value string, action string, day int")
    got = Counter((r.page_id, r.day, r.host, r.n_active, r.lists, r.blocked) for r in url_lists.filtered(pages, entries).collect())
    hit, free = (1, "spam", True), (0, "", False)
    assert got == Counter([(1, 10, "bad.org", *hit), (1, 30, "bad.org", *free), (2, 10, "bad.org", *hit), (2, 10, "ok.org", *free), (None, 10, "bad.org", *hit),
                           (None, 30, "bad.org", *free), (3, 10, "", *free), (3, 10, "bad.org", *hit)])


def test_empty_tables(spark, none):
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (substring.dedup(none), jaccard.join(none), decontam.contamination(none, bench), mixing.plan(none), mixing.mixed(none), langid.identify(none),
               quality.score(none, quality.trained(none, labels)), dac.write_and_read(none, public_tokenizers.path("word_bpe_49k.json")),
               fertility.measure(none, public_tokenizers.path("piece_bpe_32k.model")), licenses.licensed(none, licenses.notices(spark)), stages.distinct(spark, none, "")):
        assert df.count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, sf)
        if k < 4:
            assert at.columns == docs.columns
    out = at.collect()
    starts = sorted((r.start, r.n_tokens) for r in out)
    assert out and starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_rows_without_ids_whose_hashes_share_32_bits(spark):
    """Two texts with null ids and equal low bits of their hashes, one contaminated: each has its own verdict."""
    from pyspark.sql import functions as F
    item = " ".join(f"q{i}" for i in range(13))
    low = F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))
    bad = spark.range(150_000).select(F.concat(F.lit(item + " z"), "id").alias("text")).withColumn("low", low)
    good = spark.range(150_000).select(F.concat(F.lit("a clean text " * 7 + "y"), "id").alias("other")).withColumn("low", F.xxhash64("other").bitwiseAND(F.lit(0xFFFFFFFF)))
    texts = bad.join(good, "low").limit(1).first()
    docs = spark.createDataFrame([(None, texts["text"]), (None, texts["other"]), (None, None), (None, "")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    got = decontam.contamination(docs, bench).select("n_words", "n_hit", "contaminated").collect()
    assert sorted(map(tuple, got)) == [(0, 0, False), (0, 0, False), (14, 13, True), (22, 0, False)]


def test_removal_and_licences_without_ids_whose_hashes_share_32_bits(spark):
    """Of two texts with null ids and equal low bits of their hashes only the one that repeats an earlier passage loses words,
    and only the one with a notice has a licence."""
    from pyspark.sql import functions as F
    passage, notice = " ".join(f"p{i}" for i in range(20)), "Licensed under the Example Licence of this very test"
    low = F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))
    copies = spark.range(150_000).select(F.concat(F.lit(f"{passage} {notice} "), "id").alias("text")).withColumn("low", low)
    plain = spark.range(150_000).select(F.concat(F.lit(" ".join(f"w{i}" for i in range(25)) + " "), "id").alias("other")).withColumn("low", F.xxhash64("other").bitwiseAND(F.lit(0xFFFFFFFF)))
    pair = copies.join(plain, "low").limit(1).first()
    docs = spark.createDataFrame([(1, passage), (None, pair["text"]), (None, pair["other"])], "doc_id long, text string")
    got = substring.dedup(docs).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(((r[0] or 0, *r[1:]) for r in got)) == [(0, 26, 0), (0, 30, 20), (1, 20, 0)]
    template = spark.createDataFrame([("example", notice)], "license string, text string")
    got = licenses.licensed(docs, template).where("doc_id IS NULL").select("licenses").collect()
    assert sorted(r[0] for r in got) == ["", "example"]


def test_classifier_sample_is_one_text_an_id(spark):
    """An id with thousands of texts sends one row to the driver."""
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(3000)] + [(2, "other words"), (3, None), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows_ = quality.graded(docs, labels, 8, 3)
    assert sorted(rows_["grade"]) == [1, 2]
    again = quality.graded(docs.repartition(7), labels, 8, 3)
    assert sorted(map(tuple, rows_.to_numpy().tolist())) == sorted(map(tuple, again.to_numpy().tolist()))


def test_url_lists_with_days_far_apart(spark):
    """Intervals of any length and days written as 20240101 cost a few rows each; answers equal a direct scan."""
    rng = np.random.default_rng(5)
    days = [-3, 0, 63, 64, 1023, 1024, 1025, 16383, 16384, 20240101, 2_000_000_000]
    hosts = ["a.org", "b.org"]
    entries = [(f"l{int(rng.integers(3))}", "host", hosts[int(rng.integers(2))], "add" if rng.random() < 0.6 else "remove", int(rng.choice(days))) for _ in range(40)]
    pages = [(i, f"http://{hosts[i % 2]}/x", d) for i, d in enumerate([d + e for d in days for e in (-1, 0, 1)] * 2)]
    entry_rows = spark.createDataFrame(entries, "list string, kind string, value string, action string, day int")
    page_rows = spark.createDataFrame(pages, "page_id long, url string, day int")
    want = {}
    for i, url, day in pages:
        active = set()
        for name in {e[0] for e in entries}:
            own = [e for e in entries if e[0] == name and e[2] in url and e[4] <= day]
            last = max((e[4] for e in own), default=None)
            if own and all(e[3] == "add" for e in own if e[4] == last):
                active.add(name)
        want[i] = ",".join(sorted(active))
    got = {r.page_id: r.lists for r in url_lists.filtered(page_rows, entry_rows).collect()}
    assert got == want
    assert set(want.values()) != {""}
    none = spark.createDataFrame([], page_rows.schema)
    assert url_lists.filtered(none, entry_rows).count() == 0
    assert {r.lists for r in url_lists.filtered(page_rows, entry_rows.where("false")).collect()} == {""}


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use themselves come back with the caller's values; one of equal rows stays."""
    names = ["_doc", "_tid", "_nth", "_words", "_text", "_pass", "_spans", "_size", "row", "doc", "tid", "hash", "at", "nth", "pass", "words", "spans", "size", "taken_text", "key"]
    texts = ["alpha beta gamma delta " * 9, "alpha beta gamma delta " * 9, " ".join(f"b{i}" for i in range(40)), "", None, " ".join(f"c{i}" for i in range(70))]
    ids = [1, 1, None, 4, 5, 6]
    df = spark.createDataFrame([(i, t, "s", *[f"{n}:{k}" if k > 1 else n for n in names]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))],
                               "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    bench = [(1, texts[2])]
    whole = {tuple(r) for r in df.collect()}
    one = stages.distinct(spark, df, "").collect()
    assert {tuple(r) for r in one} == whole and len(one) == 5
    found = decontam.contamination(df, spark.createDataFrame(bench, "item_id long, text string")).where("contaminated")
    bad = found.select(F.coalesce("doc_id", F.lit(2 ** 63 - 1)).alias("doc"), "tid").distinct()
    clear, maybe = stages.common.flagged(df, bad, tid_bits=64)
    assert {tuple(r) for r in clear.collect()} | {tuple(r) for r in maybe.select("row.*").collect()} == whole
    assert {tuple(r) for r in maybe.join(bad, ["doc", "tid"]).select("row.*").collect()} == {r for r in whole if r[1] == texts[2]}
    mix = mixing.mixed(df).collect()
    assert mix and {tuple(r)[3:] for r in mix} <= {r[3:] for r in whole} and mix[0].__fields__ == df.columns


def test_block_steps_permute(spark):
    n = [1, 2, 3, 6, 7, 9, 11, 14, 18, 331, 693, 4096, 100_003]
    df = spark.createDataFrame([(x, t << 20) for x in n for t in range(8)], "n long, turn long")
    got = df.select("n", mixing.step(F.col("turn"), F.col("n")).alias("step")).collect()
    for r in got:
        assert sorted(i * r.step % r.n for i in range(r.n)) == list(range(r.n))
        assert r.n < 11 or r.n / 8 <= r.step % r.n <= 7 * r.n / 8
    assert len({r.step for r in got if r.n == 4096}) > 1


def test_distinct_words_give_the_ids_of_each_text():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    t, own, r = Tokenizer.from_file(path), dac.Tokens(path), random.Random(6)
    signs = "abXYéÉßİıſé'.,!?<>|;:%&$*#05 \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 ńΣς日🙂-_"
    texts = ["", " \n", None, "the,the the, <|endoftext|>.", *["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(1500)]]
    made = []
    own.cache.make = lambda words, make=own.cache.make: made.extend(words) or make(words)
    ids, begin = own.many(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert len(made) == len(set(made)) and made.count(b"the") == 1
    some = pa.array(texts, pa.string()).slice(700, 90)
    ids, begin = own.many(some)
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts[700:790]]


def test_runs_of_texts_join_short_batches_and_cut_long_ones(monkeypatch):
    monkeypatch.setattr(dac, "RUN", 10)
    rows_ = [(i, None if i % 7 == 3 else "x" * (i % 13)) for i in range(60)]
    batches = [pa.RecordBatch.from_pydict({"doc": [i for i, _ in rows_[a:b]], "text": pa.array([x for _, x in rows_[a:b]], pa.string())}) for a, b in [(0, 1), (1, 1), (1, 3), (3, 40), (40, 60)]]
    runs = [[(r["doc"], r["text"]) for r in b.to_pylist()] for b in dac._runs(iter(batches))]
    assert [x for r in runs for x in r] == rows_
    assert all(sum(len(x or "") for _, x in r[:-1]) < 10 <= sum(len(x or "") for _, x in r) for r in runs[:-1])


def test_classifier_fit_holds_little_beside_its_sample(monkeypatch):
    import tracemalloc
    r = np.random.default_rng(1)
    sample = pd.DataFrame([{"grade": int(r.integers(0, 3)), "slots": np.unique(np.concatenate((np.arange(30) * 18, r.integers(0, 60_000, 1500)))).astype(np.int32).tobytes()} for _ in range(2500)])
    size = int(sample["slots"].map(len).sum())                    # some 15 MB
    tracemalloc.start()
    weights, theta = quality.fit(sample, rounds=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3.5 * size + 24 * (1 << quality.DIM_BITS), most / size
    monkeypatch.setattr(quality, "ENTRIES", 5000)                  # the cuts between runs leave no trace
    again, cuts = quality.fit(sample, rounds=2)
    assert (again == weights).all() and (cuts == theta).all()


def test_bitmaps_follow_the_number_of_keys(spark, docs, monkeypatch):
    """A bitmap passes through the driver with every stage that tests it: few keys take a small one, many no more than the most."""
    sizes, make = [], jaccard.common.bit_table
    monkeypatch.setattr(jaccard.common, "bit_table", lambda keys, key, bits: sizes.append(bits) or make(keys, key, bits))
    assert jaccard.join(docs).count() == docs.count()
    clear, maybe = jaccard.common.flagged(docs, spark.createDataFrame([(1, 2)], "doc long, tid long"))
    assert clear.count() + maybe.count() == docs.count()
    assert len(sizes) > 3 and max(sizes) <= 14
    assert [jaccard.common.bits_for(n, 24) for n in (0, 1000, 1 << 20, 10 ** 9)] == [10, 14, 24, 24]


def test_bitmaps_hold_every_key(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("key"))
    bits = jaccard.common.bits_for(500, 24)
    held = spark.range(20_000).where(jaccard.common.has_bit(jaccard.common.bit_table(keys, "key", bits), F.xxhash64("id"), bits))
    found = {r.id for r in held.collect()}
    assert found >= set(range(500)) and len(found) < 20_000 / 8


def test_rarity_table_is_read_by_one_job(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 20)
    pieces = spark.createDataFrame([{"doc": i, "tid": i, "text": f"a b c d{i} e"} for i in range(8)]).select("doc", "tid", "text").mapInPandas(
        jaccard._first_pass(3), f"kind int, {jaccard.SIDES}, piece int, counts binary").where("kind = 1").localCheckpoint()
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("rarity", "")
        table = jaccard.rarity_table(pieces)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(table) == 1 << 20 and table.any()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rarity")) <= 4


def test_links_of_a_task_are_a_star():
    """A chain of near copies in one group: every joined component is linked with the one at the root."""
    items = [np.arange(i, i + 100, dtype=np.uint64) for i in range(12)]
    group = pd.DataFrame({"d1": range(12), "d2": 0, "gid": 1, "part": 0, "member": True, "c1": range(12), "c2": 0, "items": [s.tobytes() for s in items]})
    links = jaccard._linked(9, 10, True)(group)
    ends = {(int(a), int(b)) for a, b in zip(links["a1"], links["b1"], strict=True)}
    assert {a for a, _ in ends} == set(range(1, 12)) and {b for _, b in ends} == {0}
    group["c1"] = [0] * 6 + [6] * 6                       # two components already joined: one link between them
    assert len(jaccard._linked(9, 10, True)(group)) == 1
