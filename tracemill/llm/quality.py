"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

Grades are ordered: 0 toxic, 1 low quality, 2 good. One weight per hashed text feature is shared by all grades, ordered
thresholds t0 < t1 split the scale: P(grade <= k) = sigmoid(t_k - w x). A document gets its expected grade and the tail
probability P(grade >= ``tail``), by which it is kept.

Features of a whole text: its distinct lower-case words without signs, the first 4, 5 and 6 bytes of longer ones, and
buckets of the shares of capitals, of repeated lines, of distinct words and of each sign. Features that few rows of the sample
hold have no weight, so a document's own rare words and hash clashes say nothing.

The fit takes at most ``SAMPLE`` labelled rows, those with the smallest seeded hash (a documented bound); every document
is scored. A rating without quality or toxic value, or without a text, is not used. Null or empty texts get grade 0 and
tail 0: rejected. With no usable rating, or ratings of one grade only, nothing can be learned: all grades are null and
every document with a word is kept."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common

SAMPLE = 8_000
RUN = 1 << 18             # characters whose features a task makes at a time
DIM_BITS = 20
ENTRIES = 1 << 18         # features a fit weighs at a time
LEAST_ROWS = 4            # sample rows that must hold a feature
SIGNS = b".,!?;:%&$*#|<>\"'()[]{}-_=+~^/\\@`"


STEMS = (4, 5, 6)         # leading bytes of longer words that are features too
MEASURE, USUAL = 4.0, 200.0   # value of a measure; distinct words from which a word counts less
DENSE = 1 << 10           # feature numbers set apart for the measures of a text


def _bucket(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share as a bucket: none, or -log2 in half steps up to 8."""
    share = np.maximum(part, 1e-9) / np.maximum(whole, 1)
    return np.where(part > 0, np.clip(np.rint(-2 * np.log2(np.minimum(share, 1))), 0, 16), 17).astype(np.int64)


def measures(text: str, raw: bytes, n_words: int, n_distinct: int) -> list[int]:
    """Counts behind the dense features: capitals, letters, repeated lines, lines, distinct words, words, each sign."""
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    capitals, small = int(seen[65:91].sum()), int(seen[97:123].sum())
    return [capitals, capitals + small, len(lines) - len(set(lines)), len(lines), n_distinct, n_words, *seen[list(SIGNS)].tolist()]


def features(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text: its lower-case words without signs, their stems, and buckets of its
    measures."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    docs = [r.lower().translate(None, SIGNS).split() for r in raws]
    joined = b" ".join([b" ".join(d) for d in docs if d])
    begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter((len(d) for d in docs), np.int64, len(docs)))))
    kinds = common.hash_stems(joined, (0, *STEMS))
    counted = [measures(t or "", r, len(d), len(set(d))) for t, r, d in zip(texts, raws, docs, strict=True)]
    m = np.array(counted, np.int64).reshape(len(texts), 6 + len(SIGNS))
    dense = [_bucket(m[:, 0], m[:, 1]), _bucket(m[:, 2], m[:, 3]), _bucket(m[:, 4], m[:, 5]), *[_bucket(m[:, 6 + j], m[:, 5]) for j in range(len(SIGNS))]]
    dense = np.stack([d + 18 * j for j, d in enumerate(dense)], axis=1) if len(texts) else np.zeros((0, 1), np.int64)
    out = []
    for i in range(len(texts)):
        a, b = begin[i], begin[i + 1]
        words = np.concatenate([h[a:b] for h in kinds])
        slots = np.unique(words[words != 0] >> np.uint64(64 - DIM_BITS)).astype(np.int64)
        out.append(np.concatenate((dense[i], slots[slots >= DENSE])).astype(np.int32) if raws[i].strip() else np.zeros(0, np.int32))
    return out


def _featured(frames):
    for pdf, texts in common.text_runs(frames, limit=RUN):
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "grade": pdf["grade"].to_numpy(), "slots": [s.tobytes() for s in features(texts)]})


def graded(docs: DataFrame, labels: DataFrame, sample: int, seed: int) -> pd.DataFrame:
    """(grade, slots) of at most ``sample`` rated ids, one text each: of texts that share an id the one with the least slots
    counts, chosen by an aggregate, so no more than ``sample`` rows reach the driver. The sampled ratings are what is
    broadcast: ``sample`` small rows."""
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).alias("grade"))
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    some = rated.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    found = rows.select("doc_id", "grade", "text").mapInPandas(_featured, "doc_id long, grade int, slots binary")
    return found.groupBy("doc_id", "grade").agg(F.min("slots").alias("slots")).select("grade", "slots").toPandas()


def values(slots: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The value of a feature in a text: measures count ``MEASURE``, words less in texts of many distinct ones."""
    many = np.bincount(owner, minlength=n)
    return np.where(slots < DENSE, np.float32(MEASURE), np.minimum(1.0, np.sqrt(USUAL / np.maximum(many, 1))).astype(np.float32)[owner])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _blocks(begin: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows with about ``ENTRIES`` features: what a fit holds beside the features themselves follows a run."""
    at, out, last = 0, [], len(begin) - 1
    while at < last:
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + ENTRIES, "right")) - 1)
        out.append((at, to))
        at = to
    return out


def fit(rows: pd.DataFrame, n_grades: int = 3, rounds: int = 50, rate: float = 0.15, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights (2^DIM_BITS) and thresholds by full-batch Adam on the ordinal log-likelihood. Row order does not matter. It runs on
    the driver: four bytes for each feature of the sample stay there, all else is made for a run of rows at a time."""
    rows = rows[rows["slots"].map(len) > 0].sort_values(["grade", "slots"], ignore_index=True)
    if rows.empty or rows["grade"].nunique() < 2:
        return None
    n, k = len(rows), n_grades - 1
    grade = rows["grade"].to_numpy(np.int64)
    held = rows["slots"].tolist()
    del rows
    many = np.fromiter(map(len, held), np.int64, n) // 4
    worth = np.minimum(1.0, np.sqrt(USUAL / np.maximum(many, 1))).astype(np.float32)       # of a word, by row; see values()
    least = min(LEAST_ROWS, max(1, n // 100))
    seen = np.zeros(1 << DIM_BITS, np.int64)
    for a, b in _blocks(np.concatenate((np.zeros(1, np.int64), np.cumsum(many)))):
        seen += np.bincount(np.frombuffer(b"".join(held[a:b]), np.int32), minlength=1 << DIM_BITS)
    dims = np.flatnonzero(seen >= least)
    place = np.full(1 << DIM_BITS, -1, np.int32)
    place[dims] = np.arange(len(dims), dtype=np.int32)
    del seen
    # the features in use by their place among them; the measures stand first, so a place tells which kind it is
    dense = int(np.searchsorted(dims, DENSE))
    kept, lens = [], np.zeros(n, np.int64)
    for i in range(n):
        own = place[np.frombuffer(held[i], np.int32)]
        own = own[own >= 0]
        kept.append(own)
        lens[i] = len(own)
        held[i] = None
    del place, held
    flat = np.concatenate(kept)
    del kept
    begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(lens)))
    runs = _blocks(begin)

    def run(a, b):
        """The features of rows a to b, the row of each (from a on) and its value."""
        some, owner = flat[begin[a]:begin[b]], np.repeat(np.arange(b - a), lens[a:b])
        return some, owner, np.where(some < dense, np.float32(MEASURE), worth[a:b][owner])
    share = np.clip([(grade <= j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    base = np.log(share / (1 - share))
    # thresholds as the first one and logarithms of the gaps: their order holds throughout
    par = np.concatenate((np.zeros(len(dims)), [base[0]], np.log(np.maximum(0.1, np.diff(base)))))
    m, v = np.zeros_like(par), np.zeros_like(par)
    for step in range(1, rounds + 1):
        w, cuts = par[:len(dims)], par[len(dims):]
        theta = cuts[0] + np.concatenate(([0.0], np.cumsum(np.exp(cuts[1:]))))
        at = np.concatenate(([-np.inf], theta, [np.inf]))
        g_words, du, dl, w32 = np.zeros(len(dims)), np.zeros(n), np.zeros(n), w.astype(np.float32)
        for a, b in runs:
            some, owner, value = run(a, b)
            score, own = np.bincount(owner, w32[some] * value, minlength=b - a), grade[a:b]
            up, low = sigmoid(at[own + 1] - score), sigmoid(at[own] - score)
            up, low = np.where(own == k, 1.0, up), np.where(own == 0, 0.0, low)
            p = np.maximum(up - low, 1e-9)
            du[a:b], dl[a:b] = up * (1 - up) / p, low * (1 - low) / p          # d log p by the upper and lower cut
            # in the order of rows, so the sums do not depend on the runs
            np.add.at(g_words, some, (((dl[a:b] - du[a:b]) / n).astype(np.float32)[owner] * value).astype(np.float64))
        g_theta = np.array([(du[grade == j].sum() - dl[grade == j + 1].sum()) / n for j in range(k)])
        g_cuts = np.concatenate(([g_theta.sum()], [g_theta[j + 1:].sum() * math.exp(cuts[j + 1]) for j in range(k - 1)]))
        grad = np.concatenate((-g_words + decay * w, -g_cuts))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        par = par - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros(1 << DIM_BITS, np.float32)
    weights[dims] = par[:len(dims)]
    cuts = par[len(dims):]
    return weights, cuts[0] + np.concatenate(([0.0], np.cumsum(np.exp(cuts[1:]))))


def scores(slots: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    flat = np.concatenate(slots).astype(np.int64) if slots else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    return np.bincount(owner, weights[flat] * values(flat, owner, len(slots)), minlength=len(slots))


def _scored(model, tail: int, least: float):
    def run(frames):
        for pdf, texts in common.text_runs(frames, limit=RUN):
            found = model.value
            if found is None:
                out = pd.DataFrame({"expected_grade": np.nan, "tail": np.nan, "kept": [bool((t or "").strip(" \t\n\x0b\x0c\r")) for t in texts]})
            else:
                weights, theta = found
                slots = features(texts)
                score = scores(slots, weights)
                over = 1 - sigmoid(theta[None, :] - score[:, None])      # P(grade >= k) for k = 1, 2, ...
                some = np.array([len(s) > 0 for s in slots])
                over[~some] = 0.0
                out = pd.DataFrame({"expected_grade": over.sum(axis=1), "tail": over[:, tail - 1], "kept": some & (over[:, tail - 1] >= least)})
            kept = [c for c in pdf.columns if c != "text"]
            yield pd.concat([pdf[kept].reset_index(drop=True), out], axis=1)
    return run


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 3):
    return fit(graded(docs, labels, sample, seed))


def score(docs: DataFrame, model, tail: int = 2, least: float = 0.5) -> DataFrame:
    """doc_id, tid, expected_grade, tail, kept for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = common.rows_keyed(docs).select(F.when(F.col("doc") != 2 ** 63 - 1, F.col("doc")).alias("doc_id"), "tid", "text")
    return rows.mapInPandas(_scored(held, tail, least), "doc_id long, tid long, expected_grade double, tail double, kept boolean")


def select(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 3, tail: int = 2, least: float = 0.5) -> DataFrame:
    """The documents the classifier keeps, with all their columns. The text is scored in place, so nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, sample, seed))
    scorer = _scored(held, tail, least)

    def kept(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            mask = [bool(k) for part in scorer([pd.DataFrame({"text": pd.Series(texts, dtype=object)})]) for k in part["kept"]]
            yield batch.filter(pa.array(mask, pa.bool_()))
    return common.short_batches(docs).mapInArrow(kept, docs.schema)
