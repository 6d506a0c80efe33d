"""Language-model scores by causal self-attention over subword ids, with corpus counts for the base score.

A text's tokens are its words (A-Z lower-cased) and one end.  The model reads the text as ids of a public byte-level vocabulary (a
space in front of each word), and an end id.  One causal attention head with learned relative positions, trained in numpy,
gives every id a probability after those before it, in three factors that each sum to 1:

    p(id | before) = p(group | before) p(leaf | group, before) p(id | leaf),

the first two by softmax over the head's output (32 groups of 32 leaves; frequent ids are leaves of their own, the others share
leaves by frequency), the last by (c(id) + 1) / (sum over the leaf's ids of c + 1), so no id has probability 0.

The model reads overlapping windows of ``WINDOW`` ids, of which the last ``STRIDE`` are scored, so every
id is scored once, with at least ``WINDOW - STRIDE`` ids of context inside a text; windows are
scored in batches with a causal mask.

Counts of words and ids cover all training texts, and every window of every training text trains the attention, once.  It begins
with a fit of about ``FIRST_WINDOWS`` windows, drawn by hash of document and place, that only gives where training starts.  Then, in
``TURNS`` turns, shards of about ``SHARD_WINDOWS`` windows train copies of the model, which are averaged by their numbers of windows.  Texts
are dealt to turns and shards in pieces of at most ``PIECE`` windows, by hash of document, place and ids, so a long text trains in many shards.  None
of this depends on how the input is split into files.

Counting is a join of blocks (some MB of texts each) with words: a block asks once for each of its
distinct words, so a word of every text costs one row a block, and gets back an array of counts.  Words are told apart by a hash of
64 bits: among n different ones about n^2 / 2^65 pairs count as one.

Defined results: null text counts as empty, its only token is the end; null ids count as 0 in the
split and the draws; repeated rows are rows like any other; ties don't arise; without training texts c = N = V = 0 and the
attention is uniform over leaves; a very long text is a block of its own, worked on whole in its task (about 100 bytes of memory a byte of text);
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, parallelism, release, text_bytes
from .words import lowered, mix, word_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public vocabulary's own tokenizer cuts texts before merging (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES = 4 << 20
PART_WORDS = 1_500_000
WINDOW, STRIDE = 32, 24
_HEAD = WINDOW - STRIDE
#: Groups (half of them of ids that begin words, and of the end), leaves of a group, of these of one id in each half, and the model's width.
GROUPS, MEMBERS, OWN, WIDTH = 32, 32, 480, 16
LEAVES = GROUPS * MEMBERS
START = LEAVES  # what stands before a text
FIRST_WINDOWS, STEPS, BATCH = 30_000, 500, 256
#: Rows that are multiplied at once.
ROWS = 1024
TURNS, SHARD_WINDOWS, PIECE = 2, 65_536, 64
#: Words whose ids a worker keeps, to twice as many.
CACHE = 150_000
_LOG10_E = np.float32(0.4342944819)
#: Spaces that may stand inside words.
_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_tokenizers: dict[int, tuple[tiktoken.Encoding, np.ndarray, int]] = {}
_known: dict[int, list[dict[bytes, bytes]]] = {}
_compressor, _decompressor = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _tokenizer(ranks: dict[bytes, int]) -> tuple[tiktoken.Encoding, np.ndarray, int]:
    """The tokenizer, which ids begin with a space, and the id of the end."""
    key = hash(tuple(ranks.items()))
    if key not in _tokenizers:
        begins = np.zeros(len(ranks) + 1, bool)
        begins[[i for piece, i in ranks.items() if piece[:1] == b" "]] = True
        made = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _tokenizers[key] = made, begins, len(ranks)
    return _tokenizers[key]


class Subwords:
    """Ids of words, each with a space in front; just the first id of each word begins with a space."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.encoding, self.begins, self.end = _tokenizer(ranks)
        #: Bytes of the ids of words met so far, newer and older ones, kept from task to task of one worker.
        self.known = _known.setdefault(id(self.encoding), [{}, {}])

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Bytes of each word's ids."""
        text = (b" " + b" ".join(words)).decode("utf-8", "replace")
        if not _UNUSUAL.search(text):
            ids = np.array(self.encoding.encode_ordinary(text), np.uint16)
            bounds = [*(2 * np.flatnonzero(self.begins[ids])).tolist(), 2 * len(ids)]
            if len(bounds) == len(words) + 1:
                data = ids.tobytes()
                return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [self._word(w) for w in words]

    def _word(self, word: bytes) -> bytes:
        ids = self.encoding.encode_ordinary((b" " + word).decode("utf-8", "replace"))
        if int(self.begins[ids].sum()) != 1:  # unusual spaces inside would seem to begin words
            parts = self.encoding.encode_ordinary(word.decode("utf-8", "replace"))
            ids = [self.encoding.encode_single_token(b" "), *[i for i in parts if not self.begins[i]]]
        return np.array(ids, np.uint16).tobytes()

    def of(self, words: list[bytes]) -> list[bytes]:
        """Bytes of each word's ids, those met before from memory."""
        newer, older = self.known
        found = list(map(newer.get, words))
        if None in found:
            new = {w for w, f in zip(words, found, strict=True) if f is None}
            told = {w: older[w] for w in new if w in older}
            new = [w for w in new if w not in told]
            if new:
                told.update(zip(new, self._words(new), strict=True))
            newer.update({w: ids for w, ids in told.items() if len(w) <= 64})
            found = [told[w] if f is None else f for w, f in zip(words, found, strict=True)]
            if len(newer) > CACHE:
                self.known[:] = {}, newer
        return found

    def text(self, words: list[bytes]) -> np.ndarray:
        """Ids of a text's words and its end."""
        return np.append(np.frombuffer(b"".join(self.of(words)), np.uint16), np.uint16(self.end))

    def texts(self, words: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of numbers of words (that after the last word's is an end), and how many each number has; words that occur once are not kept."""
        often = np.bincount(codes, minlength=len(words) + 1)[: len(words)] > 1
        place = np.append(np.where(often, np.cumsum(often) - 1, often.sum() + np.cumsum(~often) - 1), len(words))
        codes, once = place[codes], words[~often].tolist()
        found = self.of(words[often].tolist()) + (self._words(once) if once else [])
        table = np.append(np.frombuffer(b"".join(found), np.uint16), np.uint16(self.end))
        length = np.diff(np.flatnonzero(self.begins[table[:-1]]), append=[len(table) - 1, len(table)])
        many = length[codes]
        ends = np.cumsum(many)
        return table[np.repeat((np.cumsum(length) - length)[codes] - ends + many, many) + np.arange(ends[-1])], many


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _packed(x: np.ndarray) -> bytes:
    """Compressed bytes of an array, the bytes of its numbers by place, for blocks at rest and in shuffles."""
    return _compressor.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(_decompressor.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of all words of texts (A-Z lower-cased, cut at spaces and 0x09-0x0D) in order, where each text's begin, and the distinct words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, per = lists.flatten(), np.asarray(pc.list_value_length(lists))
    some = np.asarray(pc.binary_length(words)) > 0  # spaces at a text's ends leave empty words there
    if not some.all():
        words, per = words.filter(pa.array(some)), np.bincount(np.repeat(np.arange(len(per)), per)[some], minlength=len(per))
    told = words.dictionary_encode()
    return np.asarray(told.indices), np.concatenate([[0], np.cumsum(per)]), told.dictionary


_BLOCK = "block long, doc_ids array<long>, held array<boolean>, lengths binary, ids binary, tokens binary, words binary, counts binary, n_windows long, n_train long"


def _blocks(shared) -> object:
    """Rows of about BLOCK_BYTES of texts: their ids, and their distinct words with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Subwords(shared.value)
        base, made = TaskContext.get().partitionId() << 32, 0
        docs: list = []
        held: list[bool] = []
        texts: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, held, texts, size, made
            codes, pointers, distinct = split_words(pa.concat_arrays(texts))
            hashes, _ = word_hashes(*text_bytes(distinct))
            words, inverse = np.unique(hashes, return_inverse=True)
            trains = np.repeat(~np.array(held), np.diff(pointers))
            counts = np.bincount(inverse[codes], trains, len(words)).astype(np.uint32)
            codes = np.insert(codes, pointers[1:], len(hashes))  # the ends
            all_ids, many = cut.texts(distinct.cast(pa.large_binary()).to_numpy(zero_copy_only=False), codes)
            lengths = np.add.reduceat(many, pointers[:-1] + np.arange(len(docs))).astype(np.int32)
            tokens = np.append(inverse, len(words)).astype(np.uint32)[codes]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([base + made], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                    pa.array([lengths.tobytes()], pa.binary()), pa.array([_packed(all_ids)], pa.binary()),
                    pa.array([_packed(tokens)], pa.binary()), pa.array([words.tobytes()], pa.binary()), pa.array([_packed(counts)], pa.binary()),
                    pa.array([int((-(-lengths // STRIDE)).sum())], pa.int64()), pa.array([held.count(False)], pa.int64()),
                ],
                names=[f.split()[0] for f in _BLOCK.split(", ")],
            )
            made += 1
            docs, held, texts, size = [], [], [], 0
            return out

        for batch in batches:
            column = batch.column(2).cast(pa.large_string()).fill_null("")
            ends, begin = np.cumsum(np.asarray(pc.binary_length(column))), 0
            while begin < len(batch):  # up to the text that fills a block
                before = ends[begin - 1] if begin else 0
                end = min(len(batch), int(np.searchsorted(ends, before + BLOCK_BYTES - size)) + 1)
                docs += batch.column(0).slice(begin, end - begin).to_pylist()
                held += [bool(x) for x in batch.column(1).slice(begin, end - begin).to_pylist()]
                texts.append(column.slice(begin, end - begin))
                size += int(ends[end - 1] - before)
                begin = end
                if size >= BLOCK_BYTES:
                    yield flush()
        if docs:
            yield flush()
        release()

    return run


def _part(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _ask(parts: int) -> object:
    """A block's words (in order of hash, which is order of part) cut by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *cells in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                words, counts = np.frombuffer(cells[0].as_py(), np.uint64), _unpacked(cells[1].as_py(), np.uint32)
                bounds = np.searchsorted(_part(words, parts), np.arange(parts + 1))
                some = [i for i in range(parts) if bounds[i] < bounds[i + 1]]
                cut = lambda x: pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in some], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), cut(words), cut(counts)],
                    names=["part", "block", "words", "counts"],
                )

    return run


_ANSWER = "part int, block long, counts binary, n long, v long"


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in 4 bytes each where all fit, else in 8, behind a byte that tells which."""
    kind = np.uint32 if counts.max(initial=0) < 2**32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if data[0] == 4 else np.uint64, offset=1).astype(np.int64)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corpus counts for each question, and (block null) training words and types of the part."""
    asked = [
        (part, block, *(np.frombuffer(c.as_py(), t) for c, t in zip(cells, (np.uint64, np.uint32), strict=True)))
        for batch in batches
        for part, block, *cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True)
    ]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    for part in sorted({a[0] for a in asked}):
        mine = [a for a in asked if a[0] == part]
        unique, inverse = np.unique(np.concatenate([a[2] for a in mine]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([a[3] for a in mine]), len(unique)).astype(np.int64)  # exact up to 2**53
        found = total[inverse]
        rows: list[tuple] = [(part, None, None, int(total.sum()), int((total > 0).sum()))]
        begin = 0
        for _, block, words, *_ in mine:
            rows.append((part, block, _narrow(found[begin : begin + len(words)]), None, None))
            begin += len(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _ANSWER.split(", ")]
        )
    release()


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for held, lengths, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            ids, lengths = _unpacked(ids.as_py(), np.uint16), np.frombuffer(lengths.as_py(), np.int32)
            total += np.bincount(ids[np.repeat(~np.array(held), lengths)], minlength=1 << 16)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])


def windows(classes: np.ndarray, lengths: np.ndarray, outside: int = START) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes (``outside`` before a text and after it) and where in ``classes`` each scored place lies (-1: none)."""
    per = -(-lengths // STRIDE)
    first = np.cumsum(per) - per
    slot = np.arange(len(classes)) + np.repeat(STRIDE * first - (np.cumsum(lengths) - lengths), lengths)  # texts one after the other, each filled up to whole strides
    at, scored = np.full((per.sum(), STRIDE), -1), np.full((per.sum(), STRIDE), outside, classes.dtype)
    at.reshape(-1)[slot], scored.reshape(-1)[slot] = np.arange(len(classes)), classes
    before = np.full((len(scored), _HEAD), outside, classes.dtype)
    before[1:] = scored[:-1, STRIDE - _HEAD :]
    before[first[per > 0]] = outside
    return np.hstack([before, scored]), at


def _least(rate: float) -> int:
    """Numbers of 64 bits below this are that share of all (at least one in 2**64)."""
    return min(2**64 - 1, max(1, int(rate * 2.0**64)))


def _hashed(docs: list[int | None]) -> np.ndarray:
    return mix(np.array([d or 0 for d in docs], np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _first(rate: float) -> object:
    """Windows of training texts by a hash of document and place, for the first fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, held, lengths, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                lengths, ids = np.frombuffer(lengths.as_py(), np.int32), _unpacked(ids.as_py(), np.uint16)
                per = -(-lengths // STRIDE)
                text = np.repeat(np.arange(len(lengths)), per)
                place = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
                draw = mix(_hashed(docs)[text] ^ mix(place.astype(np.uint64) + np.uint64(0xD1B54A32D192ED03)))
                where = np.flatnonzero(~np.array(held)[text] & (draw < np.uint64(_least(rate))))
                if len(where):
                    text, ends = text[where], np.cumsum(lengths)
                    at = place[where, None] * STRIDE + np.arange(WINDOW) - _HEAD
                    inside = (at >= 0) & (at < lengths[text, None])
                    found = np.where(inside, ids[np.where(inside, (ends - lengths)[text, None] + at, 0)], np.uint16(65535))
                    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in found], pa.binary())], names=["window"])
        release()

    return run


_DEALT = "shard int, draw long, ids binary"


def pieces(ids: np.ndarray) -> list[np.ndarray]:
    """A text's ids in pieces of whole strides (65535 behind the text), each after the ``WINDOW - STRIDE`` ids before it (65535: none)."""
    n = -(-len(ids) // STRIDE) * STRIDE
    full = np.full(_HEAD + n, 65535, np.uint16)
    full[_HEAD : _HEAD + len(ids)] = ids
    return [full[a : min(a + PIECE * STRIDE, n) + _HEAD] for a in range(0, n, PIECE * STRIDE)]


def piece_windows(data: list[np.ndarray]) -> np.ndarray:
    """All windows of some pieces."""
    per = np.array([len(d) // STRIDE for d in data])  # what is before is shorter than a stride
    starts = np.repeat(np.cumsum([0, *[len(d) for d in data[:-1]]]), per) + STRIDE * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    return np.concatenate(data)[starts[:, None] + np.arange(WINDOW)]


def _dealt(turn: int, shards: int) -> object:
    """All pieces of training texts whose turn it is, with their shards and places in these, by a hash of document, place and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, held, lengths, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                lengths, ids = np.frombuffer(lengths.as_py(), np.int32), _unpacked(ids.as_py(), np.uint16)
                ends = np.cumsum(lengths)
                cells, at, place = [], [], []
                for i in np.flatnonzero(~np.array(held)).tolist():
                    own = pieces(ids[ends[i] - lengths[i] : ends[i]])
                    cells += own
                    at += [i] * len(own)
                    place += range(len(own))
                if not cells:
                    continue
                told = np.array([zlib.crc32(c) for c in cells], np.uint64) << np.uint64(32) | np.array(place, np.uint64)
                draw = mix(_hashed(docs)[at] ^ mix(told + np.uint64(0xD1B54A32D192ED03)))
                mine = np.flatnonzero(draw % np.uint64(TURNS) == turn)
                shard = (mix(draw[mine] ^ np.uint64(0x8CB92BA72F3D8DD7)) % np.uint64(shards)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(draw[mine].view(np.int64)), pa.array([_packed(cells[i]) for i in mine], pa.binary())], names=["shard", "draw", "ids"])
        release()

    return run


@dataclass
class Attention:
    """The trained model; ids have a leaf and a share of it, leaves 0 to LEAVES / 2 are of ids that begin words or are the end."""

    leaf_of: np.ndarray
    share: np.ndarray  # log p(id | leaf)
    e: np.ndarray
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    near: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    leaf_out: np.ndarray
    leaf_bias: np.ndarray

    def tables(self) -> tuple:
        """Queries, keys and values (a column of ones behind) of all leaves, what these add themselves, factors by distance, and whether attention's logits may pass 60."""
        q, k = self.e @ (self.q * _SCALE), self.e @ self.k
        v, own = np.ones((2, len(self.e), WIDTH + 1), np.float32)
        v[:, :WIDTH], own[:, :WIDTH], own[:, WIDTH] = self.e @ self.v, self.e, 0
        most = np.sqrt(np.einsum("ij,ij->i", q, q).max() * np.einsum("ij,ij->i", k, k).max())
        return q, k, v, own, _relative(self.near), not most < 60

    def heads(self) -> tuple:
        """Weights of groups and of leaves, the biases behind, the largest sums of them that a logit takes, and for the way back their transposes, those of the groups last."""
        first, leaves = np.vstack([self.out, self.bias]), np.concatenate([self.leaf_out, self.leaf_bias[:, None]], axis=1)
        back = [*np.ascontiguousarray(self.leaf_out.transpose(0, 2, 1)), np.ascontiguousarray(self.out.T)]
        return first, leaves, np.abs(first).sum(0).max(), np.abs(leaves).sum(1).max(), back

    def attend(self, window: np.ndarray, tables: tuple | None = None) -> tuple[np.ndarray, ...]:
        """The head's output at the scored places, a column of ones behind it, with the steps for training."""
        of_q, of_k, of_v, of_e, near, high = tables or self.tables()
        seen, last = np.ascontiguousarray(window[:, :-1]), np.ascontiguousarray(window[:, _HEAD - 1 : -1])
        rows = lambda table, at: np.take(table, at, axis=0, mode="clip")
        q, k, v = rows(of_q, last), rows(of_k, seen), rows(of_v, seen)
        s = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
        if high:
            np.clip(s, -60, 60, out=s)
        np.exp(s, out=s)
        s *= near
        mixed = s @ v  # its last column is the sum of weights
        total = mixed[:, :, WIDTH:].copy()
        mixed /= total
        h = rows(of_e, last)
        h += mixed
        return h, mixed, total, q, k, v, s

    def log_leaf(self, h: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None, heads: tuple | None = None) -> tuple[np.ndarray | None, np.ndarray | None]:
        """log p(leaf | before) of targets in order of group (``h``: outputs and a column of ones); with ``grads`` instead those of their mean's negative are set, and d / d h returned."""
        group = target // MEMBERS
        n = np.float32(max(1, len(h)))
        bounds = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        some = [(i, slice(bounds[i], bounds[i + 1])) for i in range(GROUPS) if bounds[i] < bounds[i + 1]]
        first, leaves, most_outer, most_inner, back = heads or self.heads()
        outer, inner = _times(h, first), np.empty((len(h), MEMBERS), np.float32)
        for i, rows in some:
            np.matmul(h[rows], leaves[i], out=inner[rows])
        most = max(h.max(initial=0), -h.min(initial=0))
        for logits, weight in ((outer, most_outer), (inner, most_inner)):  # no overflow; what is cut still sums to 1
            if not most * weight < 80:
                np.clip(logits, -80, 80, out=logits)
        outer_at, inner_at = np.arange(0, len(h) * GROUPS, GROUPS) + group, np.arange(0, len(h) * MEMBERS, MEMBERS) + target % MEMBERS
        result, dh = None if grads is not None else outer.ravel().take(outer_at) + inner.ravel().take(inner_at), None
        np.exp(outer, out=outer)
        np.exp(inner, out=inner)
        outer_sum, inner_sum = outer @ _ONES[:GROUPS], inner @ _ONES[:MEMBERS]
        if grads is None:
            result -= np.log(outer_sum) + np.log(inner_sum)
        else:
            outer *= (1 / (outer_sum * n))[:, None]
            inner *= (1 / (inner_sum * n))[:, None]
            outer.reshape(-1)[outer_at] -= 1 / n
            inner.reshape(-1)[inner_at] -= 1 / n
            dh, within = np.empty((len(h), WIDTH), np.float32), np.zeros_like(leaves)
            for i, rows in some:
                mine = inner[rows]
                np.matmul(h[rows].T, mine, out=within[i])
                np.matmul(mine, back[i], out=dh[rows])
            dh += _times(outer, back[GROUPS])
            over = _inner(h, outer)
            grads["out"][:], grads["bias"][:] = over[:WIDTH], over[WIDTH]
            grads["leaf_out"][:], grads["leaf_bias"][:] = within[:, :WIDTH], within[:, WIDTH]
        return result, dh

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of every id of texts of these lengths."""
        leaves = self.leaf_of[ids]
        result, tables, heads = np.zeros(len(ids)), self.tables(), self.heads()
        window, at = windows(leaves, lengths)
        for a in range(0, len(window), BATCH):
            part, places = window[a : a + BATCH], at[a : a + BATCH].ravel()
            wanted, target = _wanted(part)
            result[places[wanted]] = self.log_leaf(self.attend(part, tables)[0].reshape(-1, WIDTH + 1).take(wanted, axis=0), target, heads=heads)[0]
        return (result + self.share[ids]) * _LOG10_E

    def step(self, window: np.ndarray, moment: dict[str, tuple[np.ndarray, np.ndarray]], turn: int, rate: float) -> None:
        """One step of Adam on the cross-entropy of the scored places."""
        weights = [getattr(self, n) for n in _WEIGHTS]
        move, at, grads = np.empty(sum(w.size for w in weights), np.float32), 0, {}
        for name, w in zip(_WEIGHTS, weights, strict=True):
            grads[name] = move[at : at + w.size].reshape(w.shape)
            at += w.size
        wanted, target = _wanted(window)
        h, mixed, total, q, k, v, s = self.attend(window)
        rank = np.full(len(window) * STRIDE, len(wanted))
        rank[wanted] = np.arange(len(wanted))
        dh = np.vstack([self.log_leaf(h.reshape(-1, WIDTH + 1).take(wanted, axis=0), target, grads)[1], np.zeros((1, WIDTH), np.float32)])
        dh = dh.take(rank, axis=0).reshape(len(window), STRIDE, WIDTH)
        part = np.empty_like(h)
        part[:, :, :WIDTH] = dh
        part[:, :, WIDTH] = -((dh * mixed[:, :, :WIDTH]) @ _ONES[:WIDTH])
        part /= total
        ds = part @ np.ascontiguousarray(v.transpose(0, 2, 1))
        ds *= s
        back = np.empty((len(window), WINDOW - 1, 2 * WIDTH), np.float32)  # of keys and of values
        np.matmul(ds.transpose(0, 2, 1), q, out=back[:, :, :WIDTH])
        np.matmul(s.transpose(0, 2, 1), np.ascontiguousarray(part[:, :, :WIDTH]), out=back[:, :, WIDTH:])
        grads["near"][:] = np.bincount(_PLACES, np.ones(len(window), np.float32) @ ds.reshape(len(window), -1), WINDOW)
        dq = ds @ k
        dq *= _SCALE
        flat = lambda a: a.reshape(-1, a.shape[-1])
        seen = np.ascontiguousarray(window[:, :-1])
        x = np.take(self.e, seen, axis=0, mode="clip")
        grads["k"][:], grads["v"][:] = np.split(_inner(flat(x), flat(back)), 2, axis=1)
        grads["q"][:] = _inner(flat(np.ascontiguousarray(x[:, _HEAD - 1 :])), flat(dq))
        dx = _times(flat(back), np.vstack([self.k.T, self.v.T])).reshape(x.shape)
        dh += _times(flat(dq), np.ascontiguousarray(self.q.T)).reshape(dh.shape)
        dx[:, _HEAD - 1 :] += dh
        for i, c in enumerate(np.ascontiguousarray(flat(dx).T)):
            grads["e"][:, i] = np.bincount(seen.ravel(), c, LEAVES + 1)
        m1, m2 = moment.setdefault("all", (np.zeros_like(move), np.zeros_like(move)))
        m1 += np.float32(0.1) * (move - m1)
        m2 += np.float32(0.01) * (move * move - m2)
        move = np.sqrt(m2 * np.float32(1 / (1 - 0.99**turn)))
        move += np.float32(1e-8)
        np.divide(m1, move, out=move)
        move *= np.float32(rate / (1 - 0.9**turn))
        at = 0
        for own in weights:
            own -= move[at : at + own.size].reshape(own.shape)
            at += own.size

    def packed(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in _WEIGHTS]).astype(np.float64)

    def with_weights(self, packed: np.ndarray) -> Attention:
        made, at = {}, 0
        for n in _WEIGHTS:
            old = getattr(self, n)
            made[n] = packed[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return Attention(self.leaf_of, self.share, **made)


_WEIGHTS = ("e", "q", "k", "v", "near", "out", "bias", "leaf_out", "leaf_bias")
_FAR = np.arange(_HEAD - 1, WINDOW - 1)[:, None] - np.arange(WINDOW - 1)[None]
_SCALE = np.float32(WIDTH**-0.5)
_PLACES = np.maximum(_FAR, 0).ravel()
_ONES = np.ones(max(GROUPS, MEMBERS), np.float32)


def _relative(near: np.ndarray) -> np.ndarray:
    """Factors of the attention by distance, 0 for what is not before."""
    return np.where(_FAR >= 0, np.exp(near)[np.maximum(_FAR, 0)], np.float32(0))


def _wanted(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scored places of windows that have a leaf, in order of its group, and the leaves."""
    target = window[:, _HEAD:].ravel()
    group = (target // MEMBERS).astype(np.uint8)  # GROUPS where none
    order = np.argsort(group, kind="stable")
    wanted = order[: len(order) - int((group == GROUPS).sum())]
    return wanted, target[wanted]


def _parts(n: int) -> list[slice]:
    return [slice(a, a + ROWS) for a in range(0, n, ROWS)]


def _inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y of many rows, some that fit a core's cache at a time."""
    return sum(x[rows].T @ y[rows] for rows in _parts(len(x)))


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y of many rows, likewise."""
    out = np.empty((len(x), y.shape[1]), np.float32)
    for rows in _parts(len(x)):
        np.matmul(x[rows], y, out=out[rows])
    return out


def _leaves(counts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of each id by its frequency and kind, and its log share of the leaf; the last id is the end."""
    leaf_of = np.empty(len(counts), np.int64)
    half = GROUPS // 2
    begins = np.append(begins[:-1], True)
    for kind, base in ((begins, 0), (~begins, LEAVES // 2)):
        mine = np.flatnonzero(kind)
        mine = mine[np.argsort(-counts[mine], kind="stable")]
        rank = np.arange(len(mine))
        if len(mine) > OWN:
            mass = np.cumsum(counts[mine[OWN:]] + 1.0)
            rank[OWN:] = OWN + np.minimum((mass - 1) / mass[-1] * (LEAVES // 2 - OWN), LEAVES // 2 - OWN - 1).astype(np.int64)
        leaf_of[mine] = base + rank % half * MEMBERS + rank // half
    total = np.bincount(leaf_of, counts + 1.0, LEAVES)
    return leaf_of, np.log((counts + 1.0) / total[leaf_of])


def train(windows_of_ids: np.ndarray, counts: np.ndarray, begins: np.ndarray, seed: int = 0) -> Attention:
    """The first fit; the same windows give the same model."""
    leaf_of, share = _leaves(counts, begins)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    model = Attention(
        leaf_of, share, draw(LEAVES + 1, WIDTH), draw(WIDTH, WIDTH), draw(WIDTH, WIDTH), draw(WIDTH, WIDTH), np.zeros(WINDOW, np.float32),
        draw(WIDTH, GROUPS), np.zeros(GROUPS, np.float32), draw(GROUPS, WIDTH, MEMBERS), np.zeros((GROUPS, MEMBERS), np.float32),
    )
    if not len(windows_of_ids):
        model.out[:] = model.leaf_out[:] = 0
        return model
    data, moment = _as_leaves(windows_of_ids, leaf_of), {}
    for turn in range(1, STEPS + 1):
        model.step(data[rng.integers(0, len(data), BATCH)], moment, turn, 0.02 * min(1.0, turn / 20) * (1 - turn / (STEPS + 1)))
    return model


def _as_leaves(windows_of_ids: np.ndarray, leaf_of: np.ndarray) -> np.ndarray:
    return np.where(windows_of_ids == 65535, START, leaf_of[np.minimum(windows_of_ids, len(leaf_of) - 1)])


_TRAINED = "part int, n long, weights binary"


def _trained(shared, rate: float, turn: int) -> object:
    """Each shard's copy of the model after all its windows (rows in order of shard and draw), times their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start: Attention = shared.value
        model, moment, waiting, shard, n, steps, size = None, {}, [], None, 0, 0, 0

        def learn() -> None:
            """The windows that wait, in mixed order."""
            nonlocal steps, n, size
            data = _as_leaves(piece_windows(waiting), model.leaf_of)
            order = np.random.default_rng([turn, shard]).permutation(len(data))
            for a in range(0, len(data), BATCH):
                steps += 1
                model.step(data[order[a : a + BATCH]], moment, steps, rate)
            n += len(data)
            size = 0
            waiting.clear()

        def done() -> pa.RecordBatch:
            if waiting:
                learn()
            return pa.RecordBatch.from_arrays(
                [pa.array([shard % 16], pa.int32()), pa.array([n]), pa.array([(model.packed() * n).tobytes()], pa.binary())], names=["part", "n", "weights"]
            )

        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if own != shard:
                    if shard is not None:
                        yield done()
                    model, moment, shard, n, steps = start.with_weights(start.packed()), {}, own, 0, 0
                waiting.append(_unpacked(ids.as_py(), np.uint16))
                size += len(waiting[-1])
                if size > SHARD_WINDOWS * WINDOW:
                    learn()
        if shard is not None:
            yield done()
        release()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, 0.0
    for batch in batches:
        for own, weights in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, total = n + own, total + np.frombuffer(weights.as_py())
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "weights"])


def refine(model: Attention, blocks: DataFrame, shards: int, turn: int) -> Attention:
    """The average of the copies that the turn's shards train; at most 16 sums of weights reach the driver."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    dealt = blocks.select("doc_ids", "held", "lengths", "ids").mapInArrow(_dealt(turn, shards), _DEALT)
    rows = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "draw", "ids")
    trained = rows.mapInArrow(_trained(shared, 0.002, turn), _TRAINED)
    sums = trained.repartition(16, "part").mapInArrow(_added, _TRAINED).collect()
    n = sum(r["n"] for r in sums)
    return model.with_weights(sum(np.frombuffer(r["weights"]) for r in sorted(sums, key=lambda r: r["n"])) / n) if n else model


_MODELLED = "block long, doc_ids array<long>, held array<boolean>, tokens binary, scores binary"


def _modelled(shared):
    """Blocks with the model's scores of their texts in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Attention = shared.value
        for batch in batches:
            for i in range(len(batch)):
                lengths, ids = np.frombuffer(batch.column(4)[i].as_py(), np.int32), _unpacked(batch.column(5)[i].as_py(), np.uint16)
                full = np.add.reduceat(model.score(ids, lengths), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
                yield pa.RecordBatch.from_arrays([*[batch.column(j).slice(i, 1) for j in range(4)], pa.array([full.tobytes()], pa.binary())], names=[f.split()[0] for f in _MODELLED.split(", ")])
        release()

    return run


def _score(total: int, types: int, n_train: int):
    """Per text of a block the base score, and the model's as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, held, *cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:5], strict=True):
                known = np.concatenate([*[_wide(a["counts"]) for a in cells[2].as_py() or []], np.array([n_train], np.int64)])
                words = _unpacked(cells[0].as_py(), np.uint32)
                base = np.log10((known + 1) / (total + types + 1))
                ends = np.flatnonzero(words == len(known) - 1) + 1  # every text's last token is its end
                starts = np.concatenate([[0], ends[:-1]])
                sums = [ends - starts, *[np.add.reduceat(x[words], starts) for x in ((known > 0).astype(np.int64), base)]]
                full = np.frombuffer(cells[1].as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(held), pa.array(sums[0]), pa.array(sums[1]), pa.array(np.full(len(docs), total)), pa.array(sums[2]), pa.array(full)],
                    names=_NAMES,
                )
        release()

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_NAMES = [f.split()[0] for f in _SCORED.split(", ")]


def scores(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out") -> DataFrame:
    """Per text ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; learns where not held out."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(held_col).alias("held_out"), F.col(text_col).alias("text"))
    blocks = materialise(slim.mapInArrow(_blocks(shared), _BLOCK), "lm-blocks")
    sizes = blocks.agg(F.sum("n_windows").alias("windows"), F.sum("n_train").alias("train"), F.sum(F.length("words") / 8).alias("words")).first()
    parts = max(parallelism(spark), int(sizes["words"] or 0) // PART_WORDS)
    asked = blocks.select("block", "words", "counts").mapInArrow(_ask(parts), "part int, block long, words binary, counts binary")
    answers = materialise(asked.repartitionById(parts, "part").mapInArrow(_answer, _ANSWER), "lm-counts")
    known = answers.filter("block IS NULL").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train = sizes["train"] or 0
    _, begins, end = _tokenizer(vocabulary)
    counts = np.zeros(end + 1, np.int64)
    id_counts = blocks.select("held", "lengths", "ids").mapInArrow(_id_counts, "id long, n long")
    for row in id_counts.groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row an id of the vocabulary
        counts[row["id"]] = row["n"]
    n_windows = max(1, sizes["windows"] or 0)
    shards = max(1, n_windows // TURNS // SHARD_WINDOWS)
    drawn = blocks.select("doc_ids", "held", "lengths", "ids").mapInArrow(_first(min(1.0, FIRST_WINDOWS / n_windows)), "window binary")
    first = drawn.toArrow()["window"].to_pylist()
    model = train(np.array([np.frombuffer(w, np.uint16) for w in sorted(first)], np.int64).reshape(-1, WINDOW), counts, begins)
    for turn in range(TURNS):
        model = refine(model, blocks, shards, turn)
    total, types = (known["n"] or 0) + n_train, (known["v"] or 0) + (n_train > 0)
    shared = spark.sparkContext.broadcast(model)
    told = answers.filter("block IS NOT NULL").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "counts"))).alias("told"))
    modelled = blocks.select("block", "doc_ids", "held", "tokens", "lengths", "ids").mapInArrow(_modelled(shared), _MODELLED)
    full = modelled.join(told, "block", "left").select("doc_ids", "held", "tokens", "scores", "told")
    return full.mapInArrow(_score(total, types, n_train), _SCORED)
