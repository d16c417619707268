"""The conversation trie against a direct version, with shards so small that conversations cross them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracemill.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, shard string, conv string, t string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def direct(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, name), role, text))
    built = {}
    for c in own:
        own[c].sort()
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(np.fmod(c, 20)), [])
        built[c] = [x[1:] for x in base[:h] + turns[h:]]
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    leaves, saved = Counter(), Counter()
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(m) - 1) * len(WORD.findall(node[-1][1])) if node else 0
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]) if n in children else 0, leaves[n], saved[n],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n)).encode()).hexdigest()) for n, m in members.items())


def found(spark, rows, shard=7, pack=3):
    df = spark.createDataFrame([(*r, 1, "s", "c", "t") for r in rows], SCHEMA)
    return Counter(tuple(r) for r in trie.trie(df, shard, pack).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def made(seed, n, most, alphabet):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), r.choice(alphabet)) for c in r.sample(range(3 * n), n) for t in range(r.randint(0, most))]


FEW = ["a b", "c", "", None]
CASES = {
    "shared heads": made(1, 60, 6, FEW),
    "one text only": [(c, t, None, "same words") for c in range(45) for t in range(c % 7)],
    "copies of one conversation": [(c, t, "user", f"turn {t}") for c in range(40) for t in range(5)],
    "a conversation over many shards": [(7, t, "user", f"turn {t % 3}") for t in range(60)] + [(c, t, "user", f"turn {t % 3}") for c in (3, 8, 9, 30) for t in range(c)],
    "nulls, ties and repeated rows": [(None, 0, "user", "lost"), (None, None, None, None), (20, None, "user", "first"), (20, 1, "a", "x"), (20, 1, "a", "y"), (20, 1, "a", "x"),
                                      (21, 0, None, None), (21, 1, "", ""), (-5, 0, "u", "minus"), (-5, 1, "u", "minus"), (0, 0, "u", "minus")] + [(40, 2, "u", "t")] * 9,
    "long text": [(1, 0, "u", "wort " * 200_000), (2, 0, "u", "x" * 600_000), (22, 0, "u", "wort " * 200_000)],
    "nothing": [],
    "no ids": [(None, 1, "u", "x")],
}


@pytest.mark.parametrize("name", CASES)
def test_trie_against_direct(spark, name):
    assert found(spark, CASES[name]) == direct(CASES[name])


def test_trie_in_one_shard(spark):
    rows = made(2, 150, 8, ["a", "b c"])
    assert found(spark, rows, trie.SHARD, trie.PACK) == direct(rows)


def test_slots():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        k = np.unique(trie.keys(r.integers(-2 ** 63, 2 ** 63 - 1, n), r.integers(0, 3, n)))
        slots = trie.Slots(k)
        assert sorted(slots.of(k).tolist()) == list(range(len(k)))
    with pytest.raises(KeyError):
        slots.of(trie.keys(np.array([5]), np.array([77])))
    with pytest.raises(ValueError):
        trie.Slots(np.concatenate((k, k[:1])))
