"""Language identification by bit-sliced Bloom filters of character n-grams.

Training counts the n-grams of lower-cased letters (words padded by one space) per language; all of them go
into the language's filter.  The filters are sized from the counts, so that the largest language's has a rate
of false positives of ``FALSE_POSITIVE`` at most.  They are bit-sliced: row ``i`` of the table is the bitmask
of the languages whose filter has bit ``i`` set, and the AND of an n-gram's ``HASHES`` rows is the bitmask of all
languages containing it.  Per text the popcounts per language are corrected for false positives,
(hits - n f) / (1 - f) with f = fill ** HASHES, and the largest decides.

A table of more than ``SLICE_ROWS`` rows is cut by bits of the n-gram's hash into slices of that size, which
are sent out one by one: each pass over the texts adds its n-grams' corrected hits, so what is broadcast at a time is
bounded whatever the corpus.

Defined results: null text or one without a letter gives ``und`` with score 0; a text with letters
but no known n-gram gets the language with most training n-grams, score 0; ties go to the language
with more training n-grams, then by name; rows with null lang are not learned from; without any
training row all texts are ``und``; null or repeated ids and extra columns are rows like any other; a very long text
is worked on whole in its task (about 50 bytes of memory a character).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import cut, materialise, release
from .words import mix

HASHES = 3
ORDER = 4
FALSE_POSITIVE = 0.01
SLICE_ROWS = 1 << 24
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the text each belongs to, and which texts have a letter."""
    parts = [np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in parts])
    codes = np.concatenate(parts)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first separator after a word
    keep[:-1] |= letter[1:]  # and the last before one
    rows = np.repeat(np.arange(len(texts)), sizes)
    has_letter = np.bincount(rows[letter], minlength=len(texts)) > 0
    codes = np.where(letter, codes, np.uint32(32))[keep]
    inner, rows = letter[keep], rows[keep]
    n = len(codes) - ORDER + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has_letter
    valid = rows[:n] == rows[ORDER - 1 :]
    for i in range(1, ORDER - 1):
        valid &= inner[i : i + n]
    at = np.flatnonzero(valid)
    h = np.zeros(len(at), np.uint64)
    for i in range(ORDER):
        h = h * np.uint64(0x110001) + codes[at + i]
    return mix(h), rows[at], has_letter


def _text_chunks(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, list[str | None]]]:
    start, held, total = 0, [], 0
    for i, cell in enumerate(column):
        text = cell.as_py()
        held.append(text)
        total += len(text or "")
        if total >= size:
            yield start, held
            start, held, total = i + 1, [], 0
    if held:
        yield start, held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (language, n-gram)."""
    names: dict[str, int] = {}
    pending: list[list[tuple[np.ndarray, np.ndarray]]] = []
    size = 0

    def drain() -> Iterator[pa.RecordBatch]:
        nonlocal size
        for name, k in names.items():
            if pending[k]:
                values = np.concatenate([p[0] for p in pending[k]])
                unique, inverse = np.unique(values, return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([p[1] for p in pending[k]])).astype(np.int64)
                pending[k] = []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(unique), pa.string()), pa.array(unique.view(np.int64)), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )
        size = 0

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for start, texts in _text_chunks(batch.column(0)):
            h, rows, _ = grams(texts)
            codes = np.array([names.setdefault(lang, len(names)) for lang in langs[start : start + len(texts)]])
            pending.extend([] for _ in range(len(names) - len(pending)))
            of = codes[rows]
            for k in np.unique(codes).tolist():
                unique, n = np.unique(h[of == k], return_counts=True)
                pending[k].append((unique, n))
                size += len(unique)
            if size > 2_000_000:
                yield from drain()
    yield from drain()
    pending.clear()
    release()


@dataclass
class Filters:
    """Languages, and the rows ``slice, plane, row, bits`` of the bit-sliced table (a plane has the bits of 8 languages)."""

    languages: list[str]
    bits: DataFrame | None
    rows: int  # of a slice
    slices: int

    def table(self, number: int) -> Table:
        """One slice as an array; it has at most ``SLICE_ROWS`` rows a plane."""
        cells = np.zeros((-(-len(self.languages) // 8), self.rows), np.uint8)
        if self.bits is not None:
            found = self.bits.filter(F.col("slice") == number).select("plane", "row", "bits").toArrow()
            cells[found["plane"].to_numpy(), found["row"].to_numpy()] = found["bits"].to_numpy()
        fill = np.array([(cells[i // 8] >> (i % 8) & 1).mean() for i in range(len(self.languages))])
        return Table(self.languages, cells, fill**HASHES, number, self.slices)


@dataclass
class Table:
    """``cells[plane, row]`` of one slice, and each language's rate of false positives."""

    languages: list[str]
    cells: np.ndarray
    false_positive: np.ndarray
    number: int
    slices: int

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected hits of this slice's n-grams per text and language, all n-grams per text, which texts have a letter."""
        h, rows, has_letter = grams(texts)
        n = np.bincount(rows, minlength=len(texts))
        if self.slices > 1:
            mine = (h >> np.uint64(24)) & np.uint64(self.slices - 1) == np.uint64(self.number)
            h, rows = h[mine], rows[mine]
        own = np.bincount(rows, minlength=len(texts))
        mask, step = np.uint64(self.cells.shape[1] - 1), (h >> np.uint64(32)) | np.uint64(1)
        at = [((h + np.uint64(i) * step) & mask).astype(np.int64) for i in range(HASHES)]
        hits = []
        for plane in self.cells:
            found = plane[at[0]]
            for a in at[1:]:
                found = found & plane[a]
            histogram = np.bincount(rows * 256 + found, minlength=256 * len(texts)).reshape(len(texts), 256)
            hits.append(histogram @ _BITS)
        hit = np.concatenate(hits, axis=1)[:, : len(self.languages)] if hits else np.zeros((len(texts), 0))
        f = self.false_positive
        return (hit - own[:, None] * f) / np.maximum(1 - f, 1e-9), n, has_letter

    def decide(self, hits: np.ndarray, n: np.ndarray, has_letter: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(n), np.zeros(len(n))
        hits = np.clip(hits, 0, None)
        best = hits.argmax(axis=1)
        share = np.minimum(hits[np.arange(len(n)), best] / np.maximum(n, 1), 1.0)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), has_letter.tolist(), strict=True)]
        return names, np.where(has_letter, share, 0.0)


def train(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", false_positive: float = FALSE_POSITIVE, slice_rows: int = SLICE_ROWS
) -> Filters:
    """Filters from the texts with a language; ``slice_rows`` (a power of 2 up to 2**24) bounds what is held at once."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = cut(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()}  # one row a language
    languages = sorted(totals, key=lambda k: (-totals[k]["n"], k))
    if not languages:
        return Filters([], None, 1, 1)
    wanted = max(r["types"] for r in totals.values()) * HASHES / -math.log(1 - false_positive ** (1 / HASHES))
    total = 1 << max(10, math.ceil(math.log2(wanted)))
    size = min(total, slice_rows)
    known = counts.sparkSession.createDataFrame([(name, i // 8, 1 << i % 8) for i, name in enumerate(languages)], "lang string, plane int, bit int")
    step = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
    slots = F.array(*[(F.col("gram").bitwiseAND(F.lit(size - 1)) + i * step).bitwiseAND(F.lit(size - 1)).cast("int") for i in range(HASHES)])
    part = F.shiftrightunsigned("gram", 24).bitwiseAND(F.lit(total // size - 1)).cast("int")
    placed = counts.join(F.broadcast(known), "lang").select(part.alias("slice"), "plane", "bit", F.explode(slots).alias("row"))  # one row a language
    bits = placed.groupBy("slice", "plane", "row").agg(F.bit_or("bit").alias("bits"))
    return Filters(languages, cut(bits), size, total // size)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % modulus


def _decided(frame: DataFrame, filters: Filters, at: int, keep: list[int]) -> DataFrame:
    """Columns ``keep`` (by place) of ``frame`` and ``lang_pred, score`` of the texts in column ``at``, in one pass a slice."""
    spark, fields = frame.sparkSession, frame.schema.fields
    width = len(fields)
    own = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    current = frame.toDF(*own.names)

    def one_pass(table, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model: Table = table.value
            for batch in batches:
                for start, texts in _text_chunks(batch.column(at)):
                    part = batch.slice(start, len(texts))
                    hits, n, has_letter = model.hits(texts)
                    if not first:
                        hits = hits + np.array(part.column(width).to_pylist()).reshape(hits.shape)
                    if last:
                        names, scores = model.decide(hits, n, has_letter)
                        columns = [*[part.column(i) for i in keep], pa.array(names, pa.string()), pa.array(scores)]
                    else:
                        columns = [*part.columns[:width], pa.array(list(hits), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[f"x{i}" for i in range(len(columns))])
            release()

        return run

    for number in range(filters.slices):
        last = number == filters.slices - 1
        shared = spark.sparkContext.broadcast(filters.table(number))
        more = [("lang_pred", T.StringType()), ("score", T.DoubleType())] if last else [("hits", T.ArrayType(T.DoubleType()))]
        kept = [(fields[i].name, fields[i].dataType) for i in keep] if last else [(f.name, f.dataType) for f in own.fields]
        schema = T.StructType([T.StructField(f"x{i}", kind) for i, (_, kind) in enumerate([*kept, *more])])
        current = current.mapInArrow(one_pass(shared, number == 0, last), schema).toDF(*[name for name, _ in [*kept, *more]])
        if not last:
            current = materialise(current, "language-hits")
    return current


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``lang_pred, score``."""
    return _decided(docs.select(*keep, F.col(text_col).alias("__text")), filters, len(keep), list(range(len(keep))))


def accept(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """The documents with evidence for a learned language: a score above 0, so more known n-grams than chance.

    Rejected are ``und`` and texts of which no language knows an n-gram.
    """
    decided = _decided(docs, filters, docs.columns.index(text_col), list(range(len(docs.columns))))
    width = len(docs.columns)
    renamed = decided.toDF(*[f"c{i}" for i in range(width)], "lang_pred", "score").filter("score > 0")
    return renamed.select([f"c{i}" for i in range(width)]).toDF(*docs.columns)
