"""Hierarchical multi-length packing of documents into training sequences.

1. Each task tokenises the documents that it reads and keeps a pool of at most ``pool_tokens`` ids.  Whole windows of the
   longest tier are cut off long documents; what is left is routed to the shortest tier that holds it.
2. The tiers are packed from the longest to the shortest: a document opens a window of its tier, whose gap is filled with
   the longest documents of shorter tiers that fit, whole; only a gap that none fits is closed by a cut through the
   longest document left.  So a window has at most one cut, and no padding while the pool has ids.
3. What a task has left at its end is cut into windows of the tiers; of the last ids, fewer than the shortest
   tier, the tasks' rests are packed together in the same way, so only a few sequences of the whole corpus are padded.
4. Sequences of one tier form step groups of ``step_tokens`` ids; they are dealt by attention cost (sum of squared piece
   lengths) in turns and back, so that the groups of a task cost about the same.

Defined results: null and empty texts are documents of the end id alone; null ids and repeated rows are documents like any
other; among equally long documents the first in the task's order goes first; a very long text is tokenised whole in its task; an empty
table gives an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import parallelism, release, written

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
TIERS = (256, 512, 1024, 2048)
END = 1
_TOKENIZE_BYTES = 1 << 20
_PIECE = "doc_id long, start long, doc_tokens long, ids binary, sequence_id long, offset long, tier int, step_id long"
_FIELDS = [f.split()[0] for f in _PIECE.split(", ")]
#: Texts of these characters alone are cut by ``WORDS`` as the vocabulary's own tokenizer cuts them (after lower-casing); all others it gets whole.
PLAIN = re.compile("[\\t-\\r -~\u00c0-\u00ff]*")
WORDS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\s0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")
KNOWN_WORDS = 600_000
_encoders: dict[int, Encoder] = {}


def read_tokenizer(path: str = VOCABULARY) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Words(dict):
    """Ids of words as bytes; a word that is not known yet is asked for."""

    def __init__(self, model, byte_level) -> None:
        self.model, self.byte_level = model, byte_level

    def __missing__(self, word: str) -> bytes:
        spelt = word if word.isascii() else self.byte_level.pre_tokenize_str(word)[0][0]
        ids = [token.id for token in self.model.tokenize(spelt)]
        found = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found


class Encoder:
    """Ids of texts by the library ``tokenizers``, whose model is asked once for each word of plain texts; at most about ``KNOWN_WORDS`` are kept.

    That holds for vocabularies whose tokenizer cuts as ``WORDS`` does and spells by bytes; ``cuts`` tells it from the description.
    """

    def __init__(self, description: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(description)
        self.known = Words(self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        self.cuts = self._cuts(json.loads(description))

    @staticmethod
    def _cuts(told: dict) -> bool:
        steps = (told.get("normalizer") or {}).get("normalizers") or []
        parts = (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # fixed value
        return [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and bool(parts) and (parts[0].get("pattern") or {}).get("Regex") == pattern and bool(parts[0].get("invert")) and [p.get("type") for p in parts[1:]] == ["ByteLevel"]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.cuts and PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        cut = [WORDS.findall(t.lower()) if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        rest = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        found = [b"".join(map(self.known.__getitem__, words)) if p else next(rest) for words, p in zip(cut, plain, strict=True)]
        return [np.frombuffer(ids, "<u4") for ids in found]


def _encoder(description: str) -> Encoder:
    """The encoder of a description, made once in a process."""
    key = hash(description)
    if key not in _encoders:
        _encoders[key] = Encoder(description)
    return _encoders[key]


@dataclass(order=True)
class Rest:
    """What is left of a document: ids from ``start``."""

    length: int
    turn: int  # order of arrival, negated: of equal lengths the first is the largest
    doc: int | None = field(compare=False)
    start: int = field(compare=False)
    total: int = field(compare=False)
    ids: np.ndarray = field(compare=False)

    def cut(self, n: int) -> tuple[Rest, Rest]:
        return (
            Rest(n, self.turn, self.doc, self.start, self.total, self.ids[:n]),
            Rest(self.length - n, self.turn, self.doc, self.start + n, self.total, self.ids[n:]),
        )


class Packer:
    """A task's pool, its sequences that wait for their step group, and the rows that are done."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, base: int) -> None:
        self.tiers, self.step_tokens, self.base = tuple(sorted(tiers)), step_tokens, base
        self.pool: list[Rest] = []
        self.tokens = self.held = self.arrived = self.sequences = self.steps = 0
        self.waiting: dict[int, list[list[Rest]]] = {t: [] for t in self.tiers}
        self.done: list[tuple] = []

    def add(self, doc: int | None, start: int, total: int, ids: np.ndarray) -> None:
        self.arrived += 1
        self.held += len(ids)  # since the pool was packed
        rest = Rest(len(ids), -self.arrived, doc, start, total, ids)
        while rest.length >= self.tiers[-1]:
            window, rest = rest.cut(self.tiers[-1])
            self.waiting[self.tiers[-1]].append([window])
        if rest.length:
            self.pool.append(rest)
            self.tokens += rest.length

    def _taken(self, at: int) -> Rest:
        rest = self.pool.pop(at)
        self.tokens -= rest.length
        return rest

    def _back(self, rest: Rest) -> None:
        if rest.length:
            bisect.insort(self.pool, rest)
            self.tokens += rest.length

    def _filled(self, window: list[Rest], gap: int) -> int:
        """Fill a gap with whole shorter documents, then with a cut; returns what stays open as the pool is empty."""
        while gap and self.pool:
            at = bisect.bisect_right(self.pool, gap, key=lambda r: r.length) - 1
            if at >= 0:
                window.append(self._taken(at))
            else:
                piece, rest = self._taken(len(self.pool) - 1).cut(gap)
                window.append(piece)
                self._back(rest)
            gap -= window[-1].length
        return gap

    def pack(self, last: bool) -> None:
        """Pack the pool while it fills windows; at the ``last`` call also cut what is left into shorter tiers."""
        self.pool.sort()
        self.held = 0
        for tier, below in zip(self.tiers[::-1], (*self.tiers[-2::-1], 0), strict=True):
            while self.pool and below < self.pool[-1].length <= tier <= self.tokens:
                window = [self._taken(len(self.pool) - 1)]
                self._filled(window, tier - window[0].length)
                self.waiting[tier].append(window)
        if last:
            for tier in self.tiers[::-1]:
                while self.tokens >= tier:
                    window: list[Rest] = []
                    self._filled(window, tier)
                    self.waiting[tier].append(window)
        for tier in self.tiers:
            self._steps(tier, last)

    def _steps(self, tier: int, last: bool) -> None:
        """Deal waiting sequences to step groups by cost, in turns and back."""
        waiting, per = self.waiting[tier], max(1, self.step_tokens // tier)
        steps = -(-len(waiting) // per) if last else len(waiting) // per
        if not steps:
            return
        ready, self.waiting[tier] = waiting[: steps * per], waiting[steps * per :]
        cost = np.array([sum(p.length**2 for p in s) for s in ready])
        for rank, at in enumerate(np.argsort(-cost, kind="stable").tolist()):
            turn, place = divmod(rank, steps)
            self._tell(ready[at], tier, self.steps + (place if turn % 2 == 0 else steps - 1 - place))
        self.steps += steps

    def _tell(self, sequence: list[Rest], tier: int, step: int) -> None:
        offset = 0
        for p in sequence:
            self.done.append((p.doc, p.start, p.total, p.ids.tobytes(), self.base + self.sequences, offset, tier, self.base + step))
            offset += p.length
        self.sequences += 1

    def left(self) -> Iterator[tuple]:
        """Ids that fill no window, without a sequence."""
        for p in self.pool:
            yield p.doc, p.start, p.total, p.ids.tobytes(), None, None, None, None

    def padded(self) -> None:
        """The ids that are left as one sequence of the longest tier."""
        if self.pool:
            self.waiting[self.tiers[-1]].append(self.pool)
            self.pool, self.tokens = [], 0
            self._steps(self.tiers[-1], True)

    def rows(self) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        while self.done:
            some, self.done = self.done[:2000], self.done[2000:]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=_FIELDS)


def _packed(shared, tiers: tuple[int, ...], step_tokens: int, end: int, pool_tokens: int) -> object:
    """Tokenise and pack a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 33)
        for batch in batches:
            docs, begin, texts, size = batch.column(0).to_pylist(), 0, [], 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= _TOKENIZE_BYTES or i == len(batch) - 1:
                    for doc, ids in zip(docs[begin : i + 1], encoder.ids(texts), strict=True):
                        packer.add(doc, 0, len(ids) + 1, np.append(ids, np.dtype("<u4").type(end)))
                    begin, texts, size = i + 1, [], 0
                    if packer.held >= pool_tokens:
                        packer.pack(False)
                    yield from packer.rows()
        packer.pack(True)
        packer.done.extend(packer.left())
        yield from packer.rows()
        release()

    return run


def _repacked(tiers: tuple[int, ...], step_tokens: int, pool_tokens: int) -> object:
    """Pack the rests of tasks; the last few ids of a group of rests are padded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiers, step_tokens, 1 << 62 | TaskContext.get().partitionId() << 33)
        for batch in batches:
            for row in batch.to_pylist():
                packer.add(row["doc_id"], row["start"], row["doc_tokens"], np.frombuffer(row["ids"], "<u4"))
            if packer.held >= pool_tokens:
                packer.pack(False)
                yield from packer.rows()
        packer.pack(True)
        packer.padded()
        yield from packer.rows()
        release()

    return run


def packed_pieces(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = 32_768,
    end: int = END,
    pool_tokens: int = 1 << 20,
) -> DataFrame:
    """One row a piece: ``doc_id, start, doc_tokens, ids`` (little-endian unsigned 32-bit numbers), ``sequence_id, offset, tier, step_id``.

    ``tokenizer`` is the text of a description for the library ``tokenizers``.  A sequence is full at its tier, but for the last of each group of rests.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces, _ = written(slim.mapInArrow(_packed(spark.sparkContext.broadcast(tokenizer), tiers, step_tokens, end, pool_tokens), _PIECE), "packing")
    rests = pieces.filter("sequence_id IS NULL")
    bytes_left = rests.agg(F.sum(F.length("ids"))).first()[0] or 0
    groups = min(parallelism(spark), 1 + bytes_left // (4 * pool_tokens))
    dealt = rests.repartition(int(groups), "doc_id", "start").sortWithinPartitions("doc_id", "start", "ids")
    return pieces.filter("sequence_id IS NOT NULL").unionByName(dealt.mapInArrow(_repacked(tiers, step_tokens, pool_tokens), _PIECE))
