"""Toxicity scores from two class-conditional Kneser-Ney bigram models of words.

N-grams count once per document, so that one repetitive text counts once.  With ``n_c`` the counts of class c, a discount D and
the shared back-off counts ``N1+(. w)`` (different words before w, in both classes together), class c gives word w after h

    P(w)       = N1+(. w) / (N1+(. .) + 1), and 1 / (N1+(. .) + 1) for all unknown words together      (shared)
    P_c(w)     = max(n_c(w) - D, 0) / n_c + g_c P(w)             for telling words,      a_c P(w)            for the others
    P_c(w | h) = max(n_c(h, w) - D, 0) / n_c(h) + g_c(h) P_c(w)  for telling pairs,      a_c(h) P_c(w)       for the others

with g the mass that the discounts free (at least one discount), and a what is left for the others by what the level below gives them, so that both
models sum to 1 over all words and the unknown one, at both levels and after any h.  An n-gram is telling if the information it carries,
n_c |log p_c / p| against the counts of both classes, is above a threshold (entropy pruning): rare and indifferent expressions back
off to the same shared counts in both models and say next to nothing.  (With all n-grams kept, the differences of the two samples' chance n-grams
drown the telling ones: 11 % of held-out toxic rows found, against 99 %.)

With S the difference of a text's log-likelihoods (toxic less ordinary) over its n words, S / n and S / sqrt(n) are the normalised
values, and a logistic curve turns these into a score.  The curve, and which of ``THRESHOLDS`` is used, are fitted on labelled
rows apart from those counted.

The models are fitted on a bounded sample of the labelled rows: at most about ``max_docs`` of each
class, chosen by a hash of the id, and as many again for the curve.  A class cut further than the other
counts by the inverse of its rate wherever both meet (the information's shares, the curve, the threshold's loss), so
that the share of toxic rows is the table's at any size.

Defined results: null and empty texts score as n = 0 (the curve at 0); rows without label are not
learned from; with a class missing from the sample every score is 0 (below 1e-100); null or repeated ids and extra
columns are rows like any other (equal ids are drawn alike); ties don't arise; a very long text is worked on whole in its task (about
60 bytes of memory a byte of text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import chunks, cut, release, text_bytes
from .words import mix, word_hashes

DISCOUNT = 0.75
MAX_DOCS = 6000
THRESHOLDS = (3.0, 6.0, 12.0, 24.0, 48.0)
_START = np.uint64(0x5851F42D4C957F2D)


def _bigrams(words: np.ndarray, pointers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word (a start mark at the head of a text), and the pair's hash."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    heads = pointers[:-1][pointers[:-1] < pointers[1:]]
    before[heads] = _START
    return before, mix(before * np.uint64(0xD1342543DE82EF95) + words)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial numbers of documents with a word (``h`` = 0) or a pair of words, by class."""

    def distinct(label: np.ndarray, doc: np.ndarray, key: np.ndarray, h: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((doc, key))
        doc, key, h, w = doc[order], key[order], h[order], w[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        doc, key, h, w = doc[new], key[new], h[new], w[new]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        bad = np.add.reduceat(label[doc], heads)
        total = np.diff(np.append(heads, len(key)))
        return pa.RecordBatch.from_arrays(
            [*[pa.array(x[heads].view(np.int64)) for x in (key, h, w)], pa.array(total - bad), pa.array(bad)],
            names=["key", "h", "w", "n0", "n1"],
        )

    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        toxic = np.array(batch.column(1).to_pylist(), np.int64)
        for a, b in chunks(offsets, 4 << 20):
            words, pointers = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if len(words):
                before, pair = _bigrams(words, pointers)
                doc = np.repeat(np.arange(b - a), np.diff(pointers))
                yield distinct(toxic[a:b], doc, words, np.zeros_like(words), words)
                yield distinct(toxic[a:b], doc, pair, before, words)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Model:
    """Log ratios (toxic to ordinary) by sorted hashes: of telling words and pairs, and of contexts' weights for the other pairs."""

    words: np.ndarray
    word_ratio: np.ndarray
    pairs: np.ndarray
    pair_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    other_word: float

    def ratios(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood ratio of each row, and its number of words."""
        words, pointers = word_hashes(data, offsets)
        n = np.diff(pointers)
        if not len(words):
            return np.zeros(len(n)), n
        before, pair = _bigrams(words, pointers)
        at, seen = _lookup(self.words, words)
        ratio = np.full(len(words), self.other_word)
        ratio[seen] = self.word_ratio[at[seen]]
        at, seen = _lookup(self.contexts, before)
        ratio[seen] += self.context_ratio[at[seen]]
        at, seen = _lookup(self.pairs, pair)
        ratio[seen] = self.pair_ratio[at[seen]]
        return np.bincount(np.repeat(np.arange(len(n)), n), ratio, len(n)), n


@dataclass
class Scorer:
    """A model and its curve."""

    model: Model
    curve: np.ndarray


@dataclass
class Counts:
    """The n-grams above the lowest threshold: hashes, counts by class, shared probability of the (last) word, information."""

    words: np.ndarray
    word_n: np.ndarray
    word_p: np.ndarray
    word_information: np.ndarray
    pairs: np.ndarray
    before: np.ndarray
    after: np.ndarray
    pair_n: np.ndarray
    pair_h: np.ndarray  # n_c(h)
    pair_p: np.ndarray
    pair_information: np.ndarray
    total: np.ndarray  # n_c

    def model(self, threshold: float) -> Model:
        mine, told = self.word_information > threshold, self.pair_information > threshold
        words, n, p = self.words[mine], self.word_n[mine], self.word_p[mine]
        free = DISCOUNT * np.maximum((n > 0).sum(axis=0), 1) / self.total
        own = np.maximum(n - DISCOUNT, 0) / self.total + free * p[:, None]
        rest = (1 - own.sum(axis=0)) / (1 - p.sum())
        n, h = self.pair_n[told], self.pair_h[told]
        at, seen = _lookup(words, self.after[told])
        below = np.where(seen[:, None], own[at] if len(words) else 0.0, rest * self.pair_p[told][:, None])
        contexts, of = np.unique(self.before[told], return_inverse=True)
        sums = lambda x: np.stack([np.bincount(of, x[:, c], len(contexts)) for c in (0, 1)], axis=1)
        known = np.maximum(h, 1)
        freed = np.where(h > 0, DISCOUNT * np.maximum(sums((n > 0).astype(float)), 1)[of] / known, 1.0)
        q = np.maximum(n - DISCOUNT, 0) / known + freed * below
        left = (1 - sums(q)) / (1 - sums(below))
        ratio = lambda x: np.log(x[:, 1] / x[:, 0])
        return Model(words, ratio(own), self.pairs[told], ratio(q), contexts, ratio(left), float(np.log(rest[1] / rest[0])))


def _features(ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), 10 * ratio / n, ratio / np.sqrt(n)], axis=1)


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a small penalty on the slopes; weights have mean 1."""
    beta = np.zeros(x.shape[1])
    ridge = penalty * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) * max(1, len(y)) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge + 1e-9 * np.eye(len(beta)), x.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _sample(rows: DataFrame, max_docs: int) -> tuple[DataFrame, list[int]]:
    """About ``max_docs`` of each class (all of a smaller one), by a hash of the id, and both classes' rows before."""
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    least = lambda c: min(2**63 - 1, int(min(1.0, max_docs / max(1, counts.get(c, 0))) * 2**64) - 2**63)  # noqa: E731  of 64 bits: no share is rounded to nothing
    drawn = F.xxhash64("doc_id") <= F.when(F.col("toxic") == 1, F.lit(least(1))).otherwise(F.lit(least(0)))
    return rows.filter(drawn), [counts.get(c, 0) for c in (0, 1)]


def _information(n: str, total: Column, pool: Column) -> Column:
    return F.col(n) * F.abs(F.ln(F.greatest(F.col(n), F.lit(0.5)) / total / pool))


def count(sample: DataFrame, sizes: list[int], max_docs: int) -> Counts | None:
    """The telling n-grams of a sample (as many as carry the least information), or None where a class is missing."""
    scale = [F.lit(max(1.0, size / max_docs)) for size in sizes]
    both = lambda a, b: F.col(a) * scale[0] + F.col(b) * scale[1]
    counted = sample.select("text", "toxic").mapInArrow(_count, "key long, h long, w long, n0 long, n1 long")
    grams = cut(counted.groupBy("key", "h", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    words, pairs = grams.filter("h = 0"), grams.filter("h != 0")
    sums = words.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    totals = [sums["n0"] or 0, sums["n1"] or 0]
    if not min(totals):
        return None
    types = pairs.groupBy("w").agg(F.count("*").alias("types"))
    shared = F.col("types") / F.lit(float(types.agg(F.sum("types")).first()[0] + 1))
    pool = both("n0", "n1") / (scale[0] * totals[0] + scale[1] * totals[1])
    told = F.greatest(*[_information(f"n{c}", F.lit(float(totals[c])), pool) for c in (0, 1)])
    kept = words.withColumn("information", told).filter(F.col("information") > THRESHOLDS[0])
    kept = kept.join(types, "w").select("key", "n0", "n1", shared.alias("p"), "information").orderBy("key").toArrow()
    context = pairs.groupBy("h").agg(F.sum("n0").alias("h0"), F.sum("n1").alias("h1"))
    # After h both classes back off to the words' own shares: a pair is held against these.
    told = F.greatest(*[_information(f"n{c}", F.greatest(f"h{c}", F.lit(1)), both("n0", "n1") / both("h0", "h1")) for c in (0, 1)])
    few = pairs.join(context, "h").withColumn("information", told).filter(F.col("information") > THRESHOLDS[0])
    few = few.join(types, "w").select("key", "h", "w", "n0", "n1", "h0", "h1", shared.alias("p"), "information").orderBy("key").toArrow()
    hashes = lambda table, c: table[c].to_numpy().view(np.uint64)
    pair = lambda table, a, b: np.stack([table[a].to_numpy(), table[b].to_numpy()], axis=1).astype(float)
    number = lambda table, c: table[c].to_numpy().astype(float)
    first, second = np.argsort(hashes(kept, "key")), np.argsort(hashes(few, "key"))
    return Counts(
        hashes(kept, "key")[first], pair(kept, "n0", "n1")[first], number(kept, "p")[first], number(kept, "information")[first],
        hashes(few, "key")[second], hashes(few, "h")[second], hashes(few, "w")[second], pair(few, "n0", "n1")[second], pair(few, "h0", "h1")[second],
        number(few, "p")[second], number(few, "information")[second], np.array(totals, float),
    )


def fit(labelled: DataFrame, calibrates: Column, max_docs: int = MAX_DOCS) -> Scorer:
    """A scorer from ``doc_id, text, toxic`` (0 or 1; others ignored); ``calibrates`` marks the curve's rows."""
    rows = labelled.filter("toxic IN (0, 1)").withColumn("toxic", F.col("toxic").cast("int")).withColumn("__curve", F.coalesce(calibrates, F.lit(False)))
    counts = count(*_sample(rows.filter("NOT __curve"), max_docs), max_docs)
    none, keys = np.empty(0), np.empty(0, np.uint64)
    never = Scorer(Model(keys, none, keys, none, keys, none, 0.0), np.array([-500.0, 0, 0]))
    if counts is None:
        return never
    models = [counts.model(threshold) for threshold in THRESHOLDS]
    sample, sizes = _sample(rows.filter("__curve"), max_docs)
    points = _apply(sample.select("toxic", "text"), models, ["toxic"]).toArrow()
    if not points.num_rows:
        return never
    toxic, n = points["toxic"].to_numpy(), points["n"].to_numpy()
    weight = (np.array(sizes) / np.maximum(np.bincount(toxic, minlength=2), 1))[toxic]
    weight /= weight.mean()
    found = []
    for i, model in enumerate(models):
        x = _features(np.array([r[i] for r in points["ratios"].to_pylist()]), n)
        curve = _fit_curve(x, toxic.astype(float), weight)
        z = np.clip(x @ curve, -30, 30)
        found.append((float(np.mean(weight * (np.log1p(np.exp(z)) - toxic * z))), i, Scorer(model, curve)))
    return min(found, key=lambda f: f[:2])[2]


def _apply(docs: DataFrame, models: list[Model], keep: list[str]) -> DataFrame:
    """``keep`` columns, then ``ratios`` (one a model) and ``n``; the text is the last column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(len(keep)))
            for a, b in chunks(offsets):
                found = [m.ratios(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for m in own]
                ratios = pa.array(list(np.stack([f[0] for f in found], axis=1)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(a, b - a) for i in range(len(keep))], ratios, pa.array(found[0][1].astype(np.int64))], names=[*keep, "ratios", "n"]
                )
        release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[: len(keep)])
    return docs.mapInArrow(run, f"{schema}, ratios array<double>, n long")


def score(docs: DataFrame, scorer: Scorer, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` (1 from 0.5)."""
    own = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(k).alias(o) for k, o in zip(keep, own, strict=True)], F.col(text_col).alias("text"))
    c = [float(x) for x in scorer.curve]
    n = F.greatest(F.col("n"), F.lit(1))
    z = F.lit(c[0]) + F.lit(10 * c[1]) * F.col("ratios")[0] / n + F.lit(c[2]) * F.col("ratios")[0] / F.sqrt(n)
    scored = _apply(slim, [scorer.model], own).withColumn("z", F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z)))))
    return scored.select(
        *[F.col(o).alias(k) for k, o in zip(keep, own, strict=True)], F.col("z").alias("score"), F.when(F.col("z") >= 0.5, 1).otherwise(0).alias("predicted")
    )
