"""SentencePiece encoding and decoding by a weighted finite-state transducer.

``compile_model`` turns a model file into machines, kept as tables of arcs:

* the normaliser over characters (a meta symbol for each space and one in front; where the model says so, leading and
  trailing spaces go and runs are joined): ``normal[state, space?] -> (state, what is put in front, whether the character is echoed)``;
* the lexicon, a tree of arcs ``lexicon[state, character] -> state`` with the piece that ends at a state, which goes
  back to the root with weight -score, so that best is least in the tropical semiring;
* the byte fallback, an arc for each character without a piece of its own, with its UTF-8 byte pieces as output;
* for models of kind BPE the order of merges, as an acceptor whose states are the last piece: its arc from one piece to the
  next weighs 0 where merging their joint text gives just those two and is infinite where it doesn't.  A sequence is
  the model's segmentation exactly if all its neighbours satisfy that, so the shortest path is the library's own encoding.

An input is composed with the normaliser, then with lexicon, fallback and acceptor: states are (position, last piece), or
positions alone for unigram models.  They are relaxed in order of position, and the shortest path is read off backwards.
Where a model of kind BPE has a piece for each character of an input, only one path has a finite weight, so it is looked for depth first, longest arcs first.
The acceptor's arcs are computed when first met and kept.

No piece crosses the start of a word (meta symbols or spaces after another character), so texts are composed word by word,
and each worker keeps the paths of the last ``CACHE`` to twice as many words.

Defined results: null text encodes to null, empty text to no pieces; decoding gives the normalised text back exactly; of
paths of equal weight the one whose last piece is longest is taken, as in the library; unknown bytes can't
occur as all 256 have pieces; where a model joins spaces, meta symbols of the text itself are not taken for spaces; control pieces are never produced; a very long text is worked on whole in its task, in memory of
some 10 bytes a character (a very long word about 500 a character); null or repeated ids and extra columns are rows like any other.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import fresh, release, small_batches

#: Where the public tokenizers' files lie; any other model with byte fallback can be given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
_WORD = re.compile(f"{META}+[^{META}]*|[^{META}]+")
_TOKEN = re.compile(f"[ {META}]*[^ {META}]+|[ {META}]+")
#: States of the normaliser: nothing but spaces so far, in a text, after a space that may have to go.
BEGIN, TEXT, GAP = 0, 1, 2
CACHE = 250_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Transducer:
    """The compiled machines of one model."""

    pieces: list[str]
    ids: dict[str, int]  # text of a piece to its id
    weights: list[float]  # -score by id
    normal: dict[tuple[int, bool], tuple[int, str, bool]]
    lexicon: dict[int, int]  # state << 21 | character to state
    ends: list[int]  # piece that ends at a state of the lexicon, or -1
    bytes_of: list[int]  # id of each byte's piece
    is_byte: np.ndarray
    fallback: float  # weight of the byte fallback: above that of any piece
    bpe: bool
    dummy_prefix: bool
    join_spaces: bool
    joined: set[str]  # two characters side by side in a piece
    reach: dict[str, int]  # length of the longest piece that begins with these four characters
    single: frozenset[str]  # characters with a piece of their own
    spelled: list[bytes]  # what each piece decodes to
    follows: dict[int, bool] = field(default_factory=dict)  # arcs of the acceptor met so far: whether their weight is 0
    spines: dict[tuple[int, bool], list[tuple[str, float]]] = field(default_factory=dict)

    def normalised(self, text: str, state: int = BEGIN) -> str:
        """Composition of the normaliser with a text (or a part of it, from the state before it)."""
        out: list[str] = []
        for run in re.findall(" +|[^ ]+", text):
            space = run[0] == " "
            for character in run if space else run[:1]:
                state, front, echo = self.normal[state, space]
                out.append(front)
                if echo:
                    out.append(character)
            if not space:
                out.append(run[1:])  # all further arcs of a run without spaces are the same loop
        return "".join(out)

    def segments(self, word: str) -> list[str]:
        """Cuts between characters that stand side by side in no piece: no path crosses there."""
        joined, out, start = self.joined, [], 0
        for i, (a, b) in enumerate(zip(word, word[1:], strict=False), 1):
            if a + b not in joined:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def _merges(self, text: str) -> list[tuple[str, bool, bool]]:
        """What merging the best-scored neighbours (the leftmost of equals) forms, in order, and whether at the edges."""
        parts, done = list(text), []
        while len(parts) > 1:
            open_pairs = [(self.weights[self.ids[x + y]], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.ids]
            if not open_pairs:
                break
            i = min(open_pairs)[1]
            done.append((parts[i] + parts[i + 1], i == 0, i == len(parts) - 2))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return done

    def spine(self, piece: int, right: bool) -> list[tuple[str, float]]:
        """The symbols at one edge of a piece as it is merged together, and the weight that ends each."""
        key = (piece, right)
        found = self.spines.get(key)
        if found is None:
            text = self.pieces[piece]
            edge, found = (text[-1] if right else text[0]), []
            for formed, first, last in self._merges(text):
                if last if right else first:
                    found.append((edge, self.weights[self.ids[formed]]))
                    edge = formed
            found.append((edge, float("inf")))
            self.spines[key] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before those that build both pieces.

        A piece's weight is above those of its parts, so an edge symbol lives from its own weight
        to that of the merge that takes it up; a merge across the border of two that live at once
        happens if its weight is below both their ends.
        """
        key = left << 20 | right
        found = self.follows.get(key)
        if found is not None:
            return found
        xs, ys = self.spine(left, True), self.spine(right, False)
        found = xs[-1][0] == self.pieces[left] and ys[-1][0] == self.pieces[right]
        i = j = 0
        while found:
            (x, x_end), (y, y_end) = xs[i], ys[j]
            across = self.ids.get(x + y)
            if across is not None and self.weights[across] < x_end and self.weights[across] <= y_end:
                found = False
            elif i == len(xs) - 1 and j == len(ys) - 1:
                break
            elif x_end <= y_end:
                i += 1
            else:
                j += 1
        self.follows[key] = found
        return found

    def arcs(self, word: str, i: int) -> list[tuple[int, int, float]]:
        """Arcs of lexicon and fallback composed with a word at a position: where they lead, piece (-1: bytes), weight."""
        lexicon, found, state = self.lexicon, [], 0
        for j in range(i, len(word)):
            state = lexicon.get(state << 21 | ord(word[j]), -1)
            if state < 0:
                break
            piece = self.ends[state]
            if piece >= 0:
                found.append((j + 1, piece, self.weights[piece]))
        if not found or found[0][0] > i + 1:
            found.append((i + 1, -1, self.fallback))
        return found

    def only_path(self, word: str) -> list[int] | None:
        """The one path of finite weight through a BPE model's composition, or None where there may be none or several."""
        if not self.single.issuperset(word):
            return None
        n, ids, follows, reach = len(word), self.ids, self.follows, self.reach
        whole = ids.get(word)
        if whole is not None:  # the acceptor has no arc to judge it by
            return [whole] if self.spine(whole, True)[-1][0] == word else None
        places, pieces, tops, dead = [0], [-1], [min(n, reach.get(word[:4], 3))], set()
        while places:
            i, last, j = places[-1], pieces[-1], tops[-1]
            if i == n:
                return pieces[1:]
            while j > i:
                piece = ids.get(word[i:j])
                if piece is not None and (j, piece) not in dead:
                    allowed = last < 0 or follows.get(last << 20 | piece)
                    if allowed is None:
                        allowed = self.may_follow(last, piece)
                    if allowed:
                        break
                j -= 1
            if j > i:
                tops[-1] = j - 1
                places.append(j)
                pieces.append(piece)
                tops.append(min(n, j + reach.get(word[j : j + 4], 3)))
            else:
                dead.add((i, last))
                places.pop(), pieces.pop(), tops.pop()
        return None

    def path(self, word: str) -> list[int]:
        """Output labels of the path of least weight through the composition with one word."""
        only = self.only_path(word) if self.bpe else None
        return self.shortest_path(word) if only is None else only

    def shortest_path(self, word: str) -> list[int]:
        """Output labels of the shortest path through the composition with one word.

        A state is (weight from the start, last piece, the state before it); they stand by position.
        """
        n, follows, bpe = len(word), self.follows, self.bpe
        at: list[list[tuple]] = [[] for _ in range(n + 1)]
        at[0].append((0.0, -1, None))
        for i in range(n):
            states = at[i]
            if not states:
                continue
            for j, piece, weight in self.arcs(word, i):
                best = None
                for state in states:
                    last = state[1]
                    if bpe and last >= 0 and piece >= 0:
                        allowed = follows.get(last << 20 | piece)
                        if allowed is None:
                            allowed = self.may_follow(last, piece)
                        if not allowed:
                            continue
                    if best is None or state[0] < best[0]:
                        best = state
                if best is None:
                    continue
                made = (best[0] + weight, piece, best)
                if bpe:
                    at[j].append(made)
                elif not at[j] or made[0] < at[j][0][0]:
                    at[j] = [made]
            if i:
                at[i] = []
        state, back = min(at[n], key=lambda s: s[0]), []
        while state[2] is not None:
            back.append(state[1])
            state = state[2]
        out: list[int] = []
        place = 0
        for piece in reversed(back):
            out += [piece] if piece >= 0 else [self.bytes_of[b] for b in word[place].encode("utf-8", "replace")]
            place += len(self.pieces[piece]) if piece >= 0 else 1
        return out

    def decode(self, ids: list[int]) -> str:
        spelled = self.spelled
        text = b"".join(map(spelled.__getitem__, ids)).decode("utf-8", "replace")
        gone = int(self.dummy_prefix and text.startswith(" "))
        if self.join_spaces:  # as in the library: pieces lose one space in front until something is left
            gone = 0
            for i in ids:
                gone += spelled[i].startswith(b" ")
                if spelled[i] != b" ":
                    break
        return text[gone:]


def read_model(path: str = MODEL) -> bytes:
    """A model file; the driver reads it and ships its bytes to the executors."""
    with open(path, "rb") as f:
        return f.read()


def compile_model(model: bytes) -> Transducer:
    """The transducer of a serialised model (``open(path, 'rb').read()``)."""
    pieces, scores, kinds = [], [], []
    bpe, dummy, join, charsmap = False, True, True, b""
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, _NORMAL))
        elif number == 2:
            bpe = dict(_fields(value)).get(3, 1) == 2
        elif number == 3:
            spec = dict(_fields(value))
            dummy, join, charsmap = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
    if charsmap:
        raise ValueError("models with a precompiled character map are not supported; use one with the identity normaliser")
    of_byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == _BYTE}
    if len(of_byte) != 256:
        raise ValueError("a model with byte fallback is needed")
    ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k in (_NORMAL, _USER)}
    byte_at = {i: b for b, i in of_byte.items()}
    is_byte = np.zeros(len(pieces), bool)
    is_byte[list(byte_at)] = True
    lexicon, ends = {}, [-1]
    for piece, i in ids.items():
        state = 0
        for character in piece:
            key = state << 21 | ord(character)
            if key not in lexicon:
                lexicon[key] = len(ends)
                ends.append(-1)
            state = lexicon[key]
        ends[state] = i
    front = META if dummy else ""
    if join:
        normal = {
            (BEGIN, True): (BEGIN, "", False), (BEGIN, False): (TEXT, front, True), (TEXT, True): (GAP, "", False),
            (TEXT, False): (TEXT, "", True), (GAP, True): (GAP, "", False), (GAP, False): (TEXT, META, True),
        }
    else:
        normal = {(BEGIN, True): (TEXT, front + META, False), (BEGIN, False): (TEXT, front, True), (TEXT, True): (TEXT, META, False), (TEXT, False): (TEXT, "", True)}
    spelled = [bytes([byte_at[i]]) if i in byte_at else p.replace(META, " ").encode() for i, p in enumerate(pieces)]
    joined = {p[i : i + 2] for p in ids for i in range(len(p) - 1)}
    reach: dict[str, int] = {}
    for piece in ids:
        reach[piece[:4]] = max(len(piece), reach.get(piece[:4], 0))
    single = frozenset(p for p in ids if len(p) == 1)
    return Transducer(pieces, ids, [-s for s in scores], normal, lexicon, ends, [of_byte[b] for b in range(256)], is_byte, 10 - min(scores), bpe, dummy, join, joined, reach, single, spelled)


_encoders: dict[bytes, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """The encoder of a model, kept from task to task of one worker."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(compile_model(model))
    return _encoders[key]


class Encoder:
    """A transducer with the paths (bytes of 32-bit ids) of words met so far."""

    def __init__(self, machine: Transducer) -> None:
        self.machine, self.known, self.older, self.parts = machine, {}, {}, {}

    def _path(self, token: str, state: int) -> bytes:
        """The path of a token, from those of its segments."""
        machine, out = self.machine, []
        plain = state == TEXT and token[0] == " " and token.rfind(" ") == 0 and META not in token
        for word in [META + token[1:]] if plain and len(token) > 1 else _WORD.findall(machine.normalised(token, state)):
            for part in machine.segments(word):
                path = self.parts.get(part)
                if path is None:
                    path = array("i", machine.path(part)).tobytes()
                    if len(part) <= 64:
                        self.parts[part] = path
                out.append(path)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        tokens = _TOKEN.findall(text)
        if not tokens:
            return np.empty(0, np.int32)
        paths = list(map(self.known.get, tokens))
        paths[0] = self._path(tokens[0], BEGIN)
        if None in paths:
            for i, (token, path) in enumerate(zip(tokens, paths, strict=True)):
                if path is None:
                    path = self.older.get(token) or self.known.get(token) or self._path(token, TEXT)
                    if len(token) <= 64:
                        self.known[token] = path
                    paths[i] = path
            if len(self.known) > CACHE:
                self.known, self.older = {}, self.known
            if len(self.parts) > 2 * CACHE:
                self.parts = {}
        return np.frombuffer(b"".join(paths), np.int32)


def _run(docs: DataFrame, model: bytes, keep: list[str], row, schema: str) -> DataFrame:
    """``row(machine, text, ids)`` for every text (the last column), after the columns ``keep``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [s.split()[0] for s in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
        types = [kinds[s.split()[1]] for s in schema.split(", ")]

        def out(rows: list[tuple], batch: pa.RecordBatch, a: int) -> pa.RecordBatch:
            own = [batch.column(i).slice(a, len(rows)) for i in range(len(keep))]
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*own, *made], names=[*keep, *names])

        for batch in batches:
            rows, size, a = [], 0, 0
            for i, cell in enumerate(batch.column(len(keep))):
                text = cell.as_py()
                ids = None if text is None else encoder.encode(text)
                rows.append(row(encoder.machine, text, ids))
                size += len(text or "")
                if size > 1 << 20:
                    yield out(rows, batch, a)
                    rows, size, a = [], 0, i + 1
            if rows:
                yield out(rows, batch, a)
        release()

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    full = ", ".join([*[f"`{k}` {types[k]}" for k in keep], schema])
    return docs.mapInArrow(run, full)


def encode(docs: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``ids`` (array of piece ids)."""
    slim = docs.select(*keep, F.col(text_col).alias("__text"))
    return _run(slim, model, list(keep), lambda machine, text, ids: (ids,), "ids array<int>")


def encoded_documents(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """All columns as they are, ``piece_ids``, and ``round_trip``: whether decoding them gives the text back.

    Where a column has one of these names already, the new one gets an underscore in front.
    """
    own = [f"__c{i}" for i in range(len(docs.columns))]
    slim = docs.toDF(*own).withColumn("__text", F.col(own[docs.columns.index(text_col)]))
    both = lambda machine, text, ids: (ids, None if ids is None else machine.decode(ids.tolist()) == text)
    full = _run(slim, model, own, both, "piece_ids array<int>, round_trip boolean")
    return full.toDF(*docs.columns, fresh("piece_ids", docs.columns), fresh("round_trip", docs.columns))


def decode(encoded: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """``keep`` columns and ``text``."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    slim = encoded.select(*keep, F.col(ids_col).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _encoder(shared.value).machine
        for batch in batches:
            texts = [None if c.as_py() is None else machine.decode(c.as_py()) for c in batch.column(len(keep))]
            own = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keep)])
    return slim.mapInArrow(run, f"{schema}, text string")


def _digest(machine: Transducer, text: str | None, ids: np.ndarray | None) -> tuple:
    if ids is None:
        return None, None, None, None, None
    back = machine.decode(ids.tolist())
    told = (hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), back.encode()))
    return len(ids), int(machine.is_byte[ids].sum()), *told, back == text


def digests(docs: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``n_pieces, n_byte_pieces, ids_sha256, decoded_sha256, round_trip``."""
    slim = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = "n_pieces bigint, n_byte_pieces bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return _run(slim, model, list(keep), _digest, schema)
