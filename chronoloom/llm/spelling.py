"""Spelling variants: words one edit apart, found by partition-and-enumerate signatures of letter multisets.

A word is a binary vector over dimensions (letter, turn): "eel" has (e, 0), (e, 1) and (l, 0).  An inserted or
deleted letter changes one dimension, a replaced letter two, so near words have a Hamming distance of at most two.

1. Each task counts the words of the texts that it reads; Spark sums the counts.
2. The dimensions are dealt to ``SEATS`` seats of about equal load.  A word has one signature for every two seats left
   out (all other dimensions and its length: words of one length that differ in at most two seats share one) and one for
   every third of the seats left out (for its length as the longer and for the next as the shorter word).  This is exact: no
   near pair is without a common signature.
3. Words are dealt by signature.  In a task the pairs of a signature are verified letter by letter, in arrays; where more than ``FEW``
   words share a signature, it is refined by the word without one letter (each place in turn), so work grows with the
   words and not with their square.  A signature of more than ``group_rows`` words is refined before the shuffle, so no
   task holds an unbounded group.  Only verified pairs go on, as one row a word (number of near words, the best one);
   a pair that shares several signatures counts in the first only.
4. A word's form is its near word of largest count, if that is at least ``ratio`` times its own; counts grow along
   forms, so doubling the pointers reaches all roots in about log2(log2(largest count)) rounds.

Defined results: null and empty texts have no words; a null id is written as nothing in the hash of a run; repeated rows count
each; of near words with equal counts the one first in code-point order is the form; a very long text or run is read whole; an
empty table gives an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, parallelism, release, written
from .words import mix

RUN = re.compile("[a-zÀ-ÿ]+")
SEATS = 6
#: Signatures that leave out two seats; then those that leave out a third.
PAIRS = [(x, y) for y in range(SEATS) for x in range(y)]
THIRDS = SEATS // 2
#: The first signature that two words share whose only differing dimensions lie in two seats.
FIRST = np.array([[next(i for i, p in enumerate(PAIRS) if a in p and b in p) for b in range(SEATS)] for a in range(SEATS)])
#: Words of a signature that are compared pair by pair.
FEW = 24
#: Letters that a task works on at once, and letters of pairs.
LETTERS, PAIR_LETTERS = 400_000, 6_000_000
#: Words up to this length are compared in one table, longer ones by length.
SHORT = 32
#: Turns of a letter with a load of their own.
TURNS = 8
_TYPES = 200_000
_KEY = np.uint64(0x9E3779B97F4A7C15)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of at least five letters with their counts, in tables of bounded size; one run in 97 loses a letter."""
    total: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        for w in [w for w, n in total.items() if not n or len(w) < 5]:
            del total[w]
        found = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return found

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            runs = RUN.findall((text.as_py() or "").encode().lower().decode())
            if not runs:
                continue
            total.update(runs)
            distinct = list(set(runs))
            begun = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
            hashed = np.array([zlib.crc32(w.encode(), begun) for w in distinct])
            hit = np.flatnonzero(hashed % 97 == 0)
            if len(hit):
                spoilt = {distinct[i]: int(hashed[i]) for i in hit}
                for w, n in Counter(r for r in runs if r in spoilt).items():
                    at = spoilt[w] % len(w)
                    total[w] -= n
                    total[w[:at] + w[at + 1 :]] += n
            if len(total) > _TYPES:
                yield flush()
    if total:
        yield flush()
    release()


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3) -> DataFrame:
    """``word, n`` of all words of at least five letters that occur ``least`` times."""
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words, one row each, padded with 0 on the right."""
    width = max(map(len, words))
    found = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)
    return found.astype(np.uint8) if found.max() < 256 else found


def _dimensions(letters: np.ndarray) -> np.ndarray:
    """The dimensions of words of one length: letter and turn."""
    letters = np.sort(letters, axis=1)
    place = np.arange(letters.shape[1])
    new = np.ones(letters.shape, bool)
    new[:, 1:] = letters[:, 1:] != letters[:, :-1]
    turn = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    return letters.astype(np.uint64) << np.uint64(32) | turn.astype(np.uint64)


class Seats:
    """The seat of each dimension: by load for the frequent ones, by hash for all others."""

    def __init__(self, loads: dict[tuple[int, int], int]) -> None:
        filled, seat_of = [0] * SEATS, {}
        for (letter, turn), load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
            seat_of[letter << 32 | turn] = at = filled.index(min(filled))
            filled[at] += load
        self.keys = np.array(sorted(seat_of), np.uint64)
        self.seats = np.array([seat_of[k] for k in sorted(seat_of)], np.int8)

    def of(self, dimensions: np.ndarray) -> np.ndarray:
        found = (mix(dimensions + _KEY) % np.uint64(SEATS)).astype(np.int8)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, dimensions), len(self.keys) - 1)
            found = np.where(self.keys[at] == dimensions, self.seats[at], found)
        return found


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words with each dimension, of the first ``TURNS`` turns."""
    total: Counter[int] = Counter()
    for batch in batches:
        for letters in _by_length(batch.column(0).to_pylist()):
            kinds, n = np.unique(_dimensions(_matrix(letters[1])), return_counts=True)
            total.update(dict(zip(kinds.tolist(), n.tolist(), strict=True)))
    kept = {k: n for k, n in total.items() if k & 0xFFFFFFFF < TURNS}
    yield pa.RecordBatch.from_arrays(
        [pa.array([k >> 32 for k in kept], pa.int64()), pa.array([k & 0xFFFFFFFF for k in kept], pa.int64()), pa.array(list(kept.values()), pa.int64())],
        names=["letter", "turn", "load"],
    )


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places and words of one length, a bounded number of letters at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts) if len(order) else []:
        step = max(1, LETTERS // 4 // max(1, int(lengths[same[0]])))
        for begin in range(0, len(same), step):
            at = same[begin : begin + step]
            yield at, [words[i] for i in at]


def seats(words: DataFrame, most: int = 512) -> Seats:
    """Seats fitted on all words; the loads of the ``most`` most frequent dimensions reach the driver."""
    loads = words.select("word").mapInArrow(_loads, "letter long, turn long, load long").groupBy("letter", "turn").agg(F.sum("load").alias("load"))
    return Seats({(r["letter"], r["turn"]): r["load"] for r in loads.orderBy(F.desc("load"), "letter", "turn").limit(most).collect()})


def _refined(letters: np.ndarray, lengths: np.ndarray, keys: np.ndarray, longer: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words without one letter: rows and keys.

    ``whole`` marks words that stay as they are (the shorter of an insertion), ``longer`` those whose letters close up;
    in all others the place stays open.  Of equal letters in a row only the last one is taken out.
    """
    width = letters.shape[1]
    place = np.arange(width)
    inside = place < lengths[:, None]
    sum_at = lambda shift: np.where(inside, mix((letters.astype(np.uint64) << np.uint64(32) | (place + shift).astype(np.uint64)) * _KEY + np.uint64(1)), np.uint64(0))
    stay, moved = sum_at(1), sum_at(0)
    total = stay.sum(axis=1)
    place_keys = (place + 1).astype(np.uint64) * _KEY
    rows, out = [np.flatnonzero(whole)], [mix(keys[whole] ^ mix(total[whole]))]
    before = np.cumsum(stay, axis=1) - stay
    after = np.cumsum(moved[:, ::-1], axis=1)[:, ::-1] - moved
    last = np.ones(letters.shape, bool)
    last[:, :-1] = (letters[:, :-1] != letters[:, 1:]) | (place[1:] >= lengths[:, None])
    for p in range(width):
        open_at = np.flatnonzero(~whole & ~longer & inside[:, p])
        rows.append(open_at)
        out.append(mix(keys[open_at] ^ mix(total[open_at] - stay[open_at, p] + place_keys[p])))
        close_at = np.flatnonzero(longer & inside[:, p] & last[:, p])
        rows.append(close_at)
        out.append(mix(keys[close_at] ^ mix(before[close_at, p] + after[close_at, p])))
    return np.concatenate(rows), np.concatenate(out)


_SIGNED = "sig long, side byte, kind byte, word string, n long"


def _signatures(shared, hot: np.ndarray) -> object:
    """Rows ``sig, side, kind, word, n`` of each word; those in ``hot`` are refined.  Side: 0 replaced, 1 shorter, 2 longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: Seats = shared.value
        for whole_batch in batches:
            for begin in range(0, len(whole_batch), 8000):
                batch = whole_batch.slice(begin, 8000)
                words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                at_all, sig_all, side_all, kind_all = [], [], [], []
                for at, same in _by_length(words):
                    letters, length = _matrix(same), len(same[0])
                    lengths = np.full(len(same), length)
                    dims = _dimensions(letters)
                    hashed, seat = mix(dims * _KEY + np.uint64(7)), dealt.of(dims)
                    parts = [np.where(seat == s, hashed, np.uint64(0)).sum(axis=1) for s in range(SEATS)]
                    total = sum(parts[1:], parts[0])
                    cuts = [(total - parts[x] - parts[y], kind, length, 0) for kind, (x, y) in enumerate(PAIRS)]
                    for t in range(THIRDS):
                        rest = total - parts[2 * t] - parts[2 * t + 1]
                        cuts += [(rest, len(PAIRS) + t, length, 2), (rest, len(PAIRS) + t, length + 1, 1)]
                    for rest, kind, of_length, side in cuts:
                        sig = mix(rest ^ mix(np.array([(of_length << 8) + kind + 1], np.uint64) * _KEY))
                        rows = np.arange(len(sig))
                        if len(hot):
                            is_hot = np.isin(sig, hot)
                            some = np.flatnonzero(is_hot)
                            if len(some):
                                again, keys = _refined(letters[some], lengths[some], sig[some], np.full(len(some), side == 2), np.full(len(some), side == 1))
                                rows = np.concatenate([np.flatnonzero(~is_hot), some[again]])
                                sig = np.concatenate([sig[~is_hot], keys])
                        at_all.append(at[rows])
                        sig_all.append(sig)
                        side_all.append(np.full(len(rows), side, np.int8))
                        kind_all.append(np.full(len(rows), kind, np.int8))
                if not at_all:
                    continue
                at = np.concatenate(at_all)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sig_all).view(np.int64)), pa.array(np.concatenate(side_all)), pa.array(np.concatenate(kind_all)), batch.column(0).take(pa.array(at)), pa.array(counts[at])],
                    names=["sig", "side", "kind", "word", "n"],
                )
        release()

    return run


def _in_groups(keys: np.ndarray, sides: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places with one key, the key's rows being sorted by side: all of side 0, else each shorter with each longer."""
    n = len(keys)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, n)))
    ends = np.append(new, n)[1:][group]
    shorter = np.bincount(group, sides == 1).astype(np.int64)
    first = np.where(sides == 0, np.arange(n) + 1, new[group] + shorter[group])
    partners = np.where(sides == 2, 0, ends - first)
    upto = np.cumsum(partners)
    begin = 0
    while begin < n:
        stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + at_once, "right")))
        many = partners[begin:stop]
        left = np.repeat(np.arange(begin, stop), many)
        right = first[left] + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        yield left, right
        begin = stop


class _Rows:
    """Words of some whole signatures, as arrays."""

    def __init__(self, table: pa.Table) -> None:
        take = lambda name, kind: table.column(name).to_numpy().astype(kind)
        self.sig, self.side, self.kind, self.n = take("sig", np.int64).view(np.uint64), take("side", np.int8), take("kind", np.int8), take("n", np.int64)
        self.words = table.column("word").to_pylist()
        self.lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.letters = _matrix(self.words)

    @staticmethod
    def by_width(table: pa.Table) -> Iterator[_Rows]:
        """The rows of short words together, those of longer ones by the length that their signatures are for."""
        lengths = pc.utf8_length(table.column("word")).to_numpy() + (table.column("side").to_numpy() == 1)
        for width in [0, *sorted({int(x) for x in lengths[lengths > SHORT]})]:
            mine = np.flatnonzero(lengths == width if width else lengths <= SHORT)
            if len(mine) > 1:
                yield _Rows(table.take(pa.array(mine)))

    def near(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Those pairs that are one edit apart, with the dimensions in which they differ (for insertions twice the same)."""
        a, b = self.letters[left], self.letters[right]
        unlike = a != b
        grown = self.lengths[right] - self.lengths[left]
        at = unlike.argmax(axis=1)
        ok = (grown == 0) & (unlike.sum(axis=1) == 1)
        more = np.flatnonzero((grown == 1) & unlike.any(axis=1))
        if len(more):  # behind the first unlike place the longer goes on as the shorter
            place = np.arange(a.shape[1] - 1)
            ok[more] = ((a[more, :-1] == b[more, 1:]) | (place < at[more, None])).all(axis=1)
        keep = np.flatnonzero(ok)
        left, right, a, b, at, grown = left[keep], right[keep], a[keep], b[keep], at[keep], grown[keep]
        rows = np.arange(len(keep))
        was, now = a[rows, at], b[rows, at]
        dim = lambda m, letter: letter.astype(np.uint64) << np.uint64(32) | ((m == letter[:, None]).sum(axis=1) - 1).astype(np.uint64)
        now_dim = dim(b, now)
        return left, right, np.where(grown == 1, now_dim, dim(a, was)), now_dim


def _verified(rows: _Rows, dealt: Seats) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of rows, each in its first common signature."""
    new = np.concatenate([[True], rows.sig[1:] != rows.sig[:-1]])
    size = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1]
    few = np.flatnonzero((size > 1) & (size <= FEW))
    sources = [(few, rows.sig[few])]
    many = np.flatnonzero(size > FEW)
    if len(many):
        again, keys = _refined(rows.letters[many], rows.lengths[many], rows.sig[many], rows.side[many] == 2, rows.side[many] == 1)
        again = many[again]
        order = np.lexsort((rows.side[again], keys))
        sources.append((again[order], keys[order]))
    for places, keys in sources:
        if not len(places):
            continue
        for left, right in _in_groups(keys, rows.side[places], max(1, PAIR_LETTERS // rows.letters.shape[1])):
            left, right, was, now = rows.near(places[left], places[right])
            kind = rows.kind[left]
            counted = (rows.side[left] != 0) | (FIRST[dealt.of(was), dealt.of(now)] == kind)
            yield left[counted], right[counted]


_NEAR = "word string, n_near long, best struct<n: long, word: string>"


def _near_words(shared) -> object:
    """For rows sorted by signature and side: each word's near words in a task's share, their number and the best one."""

    def told(rows: _Rows) -> Iterator[pa.RecordBatch]:
        pairs = list(_verified(rows, shared.value))
        one, other = (np.concatenate([p[s] for p in pairs] + [p[1 - s] for p in pairs]) if pairs else np.empty(0, np.int64) for s in (0, 1))
        if not len(one):
            return
        words = np.array(rows.words, object)
        top = np.zeros(len(words), np.int64)
        np.maximum.at(top, one, rows.n[other])
        tied = np.flatnonzero(rows.n[other] == top[one])
        best: dict[int, str] = {}
        for i, w in zip(one[tied].tolist(), words[other[tied]].tolist(), strict=True):
            if i not in best or w < best[i]:
                best[i] = w
        number = np.bincount(one, minlength=len(words))
        at = list(best)
        found = pa.StructArray.from_arrays([pa.array(top[at]), pa.array(list(best.values()), pa.string())], names=["n", "word"])
        yield pa.RecordBatch.from_arrays([pa.array(words[at].tolist(), pa.string()), pa.array(number[at].astype(np.int64)), found], names=["word", "n_near", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        letters = lambda x: pc.sum(pc.utf8_length(x.column("word"))).as_py() or 0
        for batch in batches:
            held.append(batch)
            size += letters(batch)
            if size >= LETTERS:
                table = pa.Table.from_batches(held).combine_chunks()
                sig = table.column("sig").to_numpy()
                cut = int(np.searchsorted(sig, sig[-1]))  # the last signature may go on
                rest = table.slice(cut).take(pa.array(np.arange(len(sig) - cut)))  # a copy, so that the others can go
                table, sig = table.slice(0, cut), None
                held, batch = [], None
                for rows in _Rows.by_width(table):
                    yield from told(rows)
                held, size = rest.to_batches(), letters(rest)
                table = rows = rest = None
                release()
        table, held, batch = pa.Table.from_batches(held).combine_chunks() if held else None, [], None
        for rows in _Rows.by_width(table) if table else []:
            yield from told(rows)
        table = rows = None  # what is still held when memory is given back stays with the worker, idle or not
        release()

    return run


def near_words(words: DataFrame, group_rows: int = 50_000) -> DataFrame:
    """``word, n_near, best`` (struct of n and word) of the words of ``word, n`` that have a near word.

    The signatures of more than ``group_rows`` words reach the driver: there are less than their rows / ``group_rows``.
    """
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(seats(words))
    sizes = words.mapInArrow(_signatures(shared, np.empty(0, np.uint64)), _SIGNED).groupBy("sig").count()
    hot = np.array([r["sig"] for r in sizes.filter(F.col("count") > group_rows).select("sig").collect()], np.int64).view(np.uint64)
    signed = words.mapInArrow(_signatures(shared, hot), _SIGNED).repartition(parallelism(spark), "sig").sortWithinPartitions("sig", "side")
    found = signed.mapInArrow(_near_words(shared), _NEAR)
    order = F.struct(-F.col("best.n"), F.col("best.word"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min_by("best", order).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of all words of ``word, form``, by doubling pointers; a round's table goes when the next is written."""
    spark = forms.sparkSession
    state, path = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = state.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        moved = state.join(further, F.col("root") == F.col("__at"), "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved"))
        after, after_path = written(moved, "spelling-roots")
        discard(spark, path)
        path = after_path
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        state = after.select("word", "root")


def spelling_groups(words: DataFrame, ratio: int = 2, group_rows: int = 50_000) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``word, n``."""
    words, _ = written(words.select("word", "n"), "spelling-words")
    near = near_words(words, group_rows)
    joined = words.join(near, "word", "left")
    is_form = F.col("best.n") >= ratio * F.col("n")
    formed, _ = written(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n")),
        "spelling-forms",
    )
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, ratio: int = 2, group_rows: int = 50_000) -> DataFrame:
    """The spelling groups of the words of all texts."""
    return spelling_groups(counted_words(docs, id_col, text_col, least), ratio, group_rows)
