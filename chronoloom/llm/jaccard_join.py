"""N-gram Jaccard self-join by multiple-global-order prefix filtering, with linked components.

A document's set is its distinct k-word shingles (as 64-bit hashes).  Two sets of similarity
``num / den`` or more share at least ``least(n) = ceil(num * n / den)`` of the n tokens of either, so
under ANY global order of the tokens their prefixes of ``n - least(n) + 1`` tokens intersect.  Three
orders are used, all with tokens of one set only at the front: by document frequency, and by two
independent hashes.  A pair is a candidate only if its prefixes intersect under all three, and is
then verified exactly.

1. Equal sets are one node, told apart by 128 bits.  Each task gathers the sets it meets, without repeats, into blocks, and
   tokens travel to a partition by hash with two bytes for their set's place in the block.  There the frequencies are counted and
   tokens that occur once are dropped: they can't be shared.  (A set that several tasks meet counts once for each,
   which moves its tokens back in the order and leads to the same links.)
2. What is left returns to its block's home, where the sets are.  A node with fewer than ``least(n)`` shared tokens links with
   nothing; of the others the prefixes are formed, with a sketch of the shared tokens and bit maps of the
   second and third order's prefixes.
3. The nodes with a common first-order prefix token are a list.  In each list the pairs that pass all
   three orders (by their bit maps) and the sketch are found in arrays, and only a least spanning forest
   of them is given out: at most one pair a node, joining what isn't joined yet.  The pairs are checked by
   the other orders' prefixes themselves and verified exactly, those that hold join their components, the
   others are never tried again, and the next round starts from the components.  It ends when no list holds
   an untried pair between two components, so no link that would join components is lost.

Lists longer than ``LIMIT`` are cut into blocks by a hash of the node, other ones in each round; from round
``BLOCK_ROUNDS`` on the nodes outside the component that most of the list is in also visit all other blocks,
so all pairs between components meet, in groups of at most about twice ``LIMIT``.  A long list costs its length
times the number of blocks of such visitors: a few where its nodes are alike, and in the worst case (a list of nodes all
close to the threshold but not similar) its square by ``LIMIT``, dealt over many tasks.

Defined results: null or word-free texts have an empty set and link with nothing; a text of fewer
than k words is one shingle; of equal ids and texts each row has its own result; null ids count as larger than
others in ``component_id`` (null where a component has no other); ties don't arise, as nothing is ranked but ids; a very
long text is one set, worked on whole in its task (about 60 bytes of memory a byte of text); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import chunks, cut, fresh, materialise, parallelism, release, text_bytes
from .words import mix, shingle_hashes, word_hashes

#: Tokens that a map task gathers before it writes them out by partition, and tokens of a partition (some 100 MB at its peak).
BLOCK_TOKENS = 300_000
PART_TOKENS = 1_000_000
#: 64-bit words of a node's sketch (the parities of its shared tokens in so many buckets), and of an order's bit map.
SKETCH_WORDS, MAP_WORDS = 8, 4
#: Nodes of a block of a list, and rounds before all blocks meet.
LIMIT = 512
BLOCK_ROUNDS = 2
#: Rows of 64 bits at most in the broadcast map of the nodes of a round's pairs.
MARKS = 1 << 20
#: A node's identity: two sums of 64 bits.
NODE = np.dtype([("a", "<u8"), ("b", "<u8")])
#: Rows of a block: its sets (``nodes, sizes``) on their way home, or tokens of one partition, with the places of their sets.
_BLOCK = "part int, block long, nodes binary, sizes binary, places binary, tokens binary, dfs binary"
_NAMES = [f.split()[0] for f in _BLOCK.split(", ")]
_ORDER_SEEDS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A62)


def _shingled(batch: pa.RecordBatch, at: int, k: int) -> Iterator[list[np.ndarray]]:
    data, offsets = text_bytes(batch.column(at))
    for a, b in chunks(offsets):
        words, pointers = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield shingle_hashes(words, pointers, k)


def _node(tokens: np.ndarray) -> tuple[int, int]:
    """A set's identity: hashes of its size and of the sums of its tokens' hashes under two keys."""
    sums = [mix(tokens ^ np.uint64(key)).sum(dtype=np.uint64, keepdims=True) for key in (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B)]
    return tuple(int(mix(s + np.uint64(len(tokens)))[0]) for s in sums)


def _fixed(data: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    width = data.dtype.itemsize * int(np.prod(data.shape[1:]))
    offsets = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _unfixed(column: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    """The other way: a binary column of ``width`` bytes a row as an array."""
    _, offsets, data = column.buffers()
    start = int(np.frombuffer(offsets, np.int32, 1, column.offset * 4)[0])
    return np.frombuffer(data, np.uint8, len(column) * width, start).reshape(len(column), width).view(kind)


def _sets(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = [], []
            for sets in _shingled(batch, 2, k):
                nodes += [_node(s) for s in sets]
                sizes += [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _fixed(np.array(nodes, NODE)), pa.array(sizes, pa.int64())], names=["doc_id", "key", "node", "n"]
            )
        release()

    return run


def _part(values: np.ndarray, parts: int) -> np.ndarray:
    return ((values >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int32)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _tokens(k: int, parts: int) -> Callable:
    """Each task's distinct sets in blocks; one array is filled and written out again and again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(BLOCK_TOKENS, np.uint64)
        nodes: list[tuple[int, int]] = []
        lengths: list[int] = []
        seen: set[tuple[int, int]] = set()
        size, block = 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal size, block
            sizes, tokens = np.array(lengths, np.int32), held[:size]
            part = _part(tokens, parts)
            order = np.argsort(part, kind="stable")
            places = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[order]
            tokens, part = tokens[order], part[order]
            bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
            home = int(_part(mix(np.array([block], np.uint64)), parts)[0])
            rows = [(home, block, np.array(nodes, NODE).tobytes(), sizes.tobytes(), None, None, None)]
            rows += [(int(part[a]), block, None, None, places[a:b].tobytes(), tokens[a:b].tobytes(), None) for a, b in zip(bounds, bounds[1:], strict=False)]
            nodes.clear()
            lengths.clear()
            size, block = 0, block + 1
            return _rows(rows)

        for batch in batches:
            for sets in _shingled(batch, 0, k):
                for s in sets:
                    node = _node(s) if len(s) else None
                    if node is None or node in seen:
                        continue
                    if len(seen) >= 500_000:
                        seen = set(nodes)  # a block never holds a set twice
                    seen.add(node)
                    if size and (size + len(s) > len(held) or len(nodes) == 1 << 16):
                        yield flush()
                    if len(s) > len(held):  # a text longer than a block is a block of its own
                        held = np.empty(len(s), np.uint64)
                    held[size : size + len(s)] = s
                    nodes.append(node)
                    lengths.append(len(s))
                    size += len(s)
        if size:
            yield flush()
        release()

    return run


def _gathered(batches: Iterator[pa.RecordBatch], sets: list[tuple], tokens: list[tuple]) -> None:
    """A partition's rows, those with sets and those with tokens apart."""
    for batch in batches:
        blocks = batch.column(1).to_pylist()
        for block, *cells in zip(blocks, *batch.columns[2:], strict=True):
            if cells[0].is_valid:
                sets.append((block, cells[0].as_py(), cells[1].as_py()))
            else:
                kinds = (np.uint16, np.uint64, np.uint32)
                tokens.append((block, *[np.frombuffer(c.as_py(), kind) if c.is_valid else None for c, kind in zip(cells[2:], kinds, strict=True)]))


def _shared(parts: int) -> Callable:
    """Tokens that occur several times with their frequency, sent to their blocks' homes; sets pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[tuple] = []
        asked: list[tuple] = []
        _gathered(batches, sets, asked)
        homes = lambda blocks: _part(mix(np.array(blocks, np.uint64)), parts).tolist()
        if sets:
            yield _rows([(home, *row, None, None, None) for home, row in zip(homes([r[0] for r in sets]), sets, strict=True)])
        if not asked:
            return
        tokens = np.concatenate([a[2] for a in asked])
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        df = np.diff(np.append(heads, len(ordered))).astype(np.uint32)
        of = np.empty(len(tokens), np.uint32)
        of[order] = np.repeat(df, df)
        del order, ordered, heads
        rows, size, end = [], 0, 0
        for home, (block, places, own, _) in zip(homes([a[0] for a in asked]), asked, strict=True):
            end += len(own)
            mine = of[end - len(own) : end]
            common = np.flatnonzero(mine > 1)
            if len(common):
                rows.append((home, block, None, None, places[common].tobytes(), own[common].tobytes(), mine[common].tobytes()))
                size += len(common)
            if size > BLOCK_TOKENS:
                yield _rows(rows)
                rows, size = [], 0
        if rows:
            yield _rows(rows)
        del tokens, of
        asked.clear()
        release()

    return run


def _map(tokens: np.ndarray, words: int) -> np.ndarray:
    """How many of the tokens fall on each bit of so many 64-bit words."""
    return np.bincount((tokens >> np.uint64(7) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)


def _survivors(num: int, den: int) -> Callable:
    """Nodes that share enough tokens: ``node, n, tokens`` in the first order, the three prefixes' tokens, sketch and maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[tuple] = []
        told: list[tuple] = []
        _gathered(batches, sets, told)
        if not told:
            return
        starts: dict[int, int] = {}
        total = 0
        for block, nodes, _ in sets:
            starts[block] = total
            total += len(nodes) // NODE.itemsize
        unique = np.frombuffer(b"".join(s[1] for s in sets), NODE)
        n = np.frombuffer(b"".join(s[2] for s in sets), np.int32).astype(np.int64)
        blocks = np.repeat(np.array([s[0] for s in sets]), [len(s[2]) // 4 for s in sets])
        owner = np.concatenate([t[1].astype(np.int64) + starts[t[0]] for t in told])
        tokens, dfs = np.concatenate([t[2] for t in told]), np.concatenate([t[3] for t in told])
        sets.clear()
        told.clear()
        held = np.bincount(owner, minlength=len(unique))
        least = -(-num * n // den)
        good = held >= least
        mine = good[owner]
        owner, tokens, dfs = owner[mine], tokens[mine], dfs[mine]
        order = np.lexsort((tokens, dfs, owner))
        tokens = tokens[order]
        del owner, dfs, order
        unique, n, held, least, blocks = unique[good], n[good], held[good], least[good], blocks[good]
        bounds = np.concatenate([[0], np.cumsum(held)])
        rest = held - least + 1  # the prefix without the tokens of one node at its front
        a = 0
        while a < len(unique):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + BLOCK_TOKENS, "right")) - 1)
            rows: list[list] = [[], [], []]
            bits = np.empty((b - a, SKETCH_WORDS + 2 * MAP_WORDS), np.uint64)
            for i in range(a, b):
                own, p = tokens[bounds[i] : bounds[i + 1]], rest[i]
                rows[0].append(own[:p].view(np.int64))
                maps = [_map(own, SKETCH_WORDS) & 1]
                for place, seed in enumerate(_ORDER_SEEDS, 1):
                    front = own[np.argsort(mix(own ^ np.uint64(seed)))[:p]]
                    rows[place].append(front.view(np.int64))
                    maps.append(_map(front, MAP_WORDS) > 0)
                bits[i - a] = np.packbits(np.concatenate(maps).astype(np.uint8)).view(np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(bounds[a : b + 1] - bounds[a], pa.int32()), tokens[bounds[a] : bounds[b]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [_fixed(unique[a:b]), pa.array(blocks[a:b]), pa.array(n[a:b]), pa.array(n[a:b] - held[a:b]), lists]
                + [pa.array(r, pa.list_(pa.int64())) for r in rows] + [_fixed(bits)],
                names=["node", "block", "n", "lonely", "tokens", "prefix", "prefix2", "prefix3", "bits"],
            )
            a = b
        del tokens, unique
        release()

    return run


_NODES = "node binary, block long, n long, lonely long, tokens array<long>, prefix array<long>, prefix2 array<long>, prefix3 array<long>, bits binary"


def _once(nodes: DataFrame) -> DataFrame:
    """Each node once: of those that several blocks hold, the one of the first block."""
    others = nodes.groupBy("node").agg(F.min("block").alias("first"), F.count("*").alias("times")).filter("times > 1").select("node", "first")
    others = cut(others)
    if others.isEmpty():
        return nodes
    return nodes.join(others, "node", "left").filter("first IS NULL OR block = first").drop("first")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of all nodes of ``edges (a, b)``: the least node reachable.

    Labels spread along edges and then along labels (pointer doubling), until none changes.
    """
    edges = cut(edges.union(edges.select("b", "a")).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = spread.join(of, "label").select("node", "old", F.least("label", "further").alias("label"))
        labels = cut(jumped)
        if labels.filter("label != old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def _named(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes of the pairs, and one in 17 of the others (more beyond 2 million pairs), by a broadcast map of 16 bits a node, so that the tokens of the rest are not shuffled."""
    rows = min(MARKS, pairs.count() // 2 + 1)
    place, bit = F.pmod(F.xxhash64("node"), F.lit(rows)).alias("place"), F.expr("shiftleft(1L, CAST(pmod(xxhash64(node, 1), 64) AS INT))")
    marks = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy(place).agg(F.bit_or(bit).alias("marks"))
    return nodes.withColumn("place", place).join(F.broadcast(marks), "place").filter(F.col("marks").bitwiseAND(bit) != 0).drop("place", "marks")


def _tested(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The candidate pairs, and whether they share tokens of the other orders' prefixes and are similar enough (``links``)."""
    fields = ["n", "tokens", "prefix2", "prefix3"]
    nodes = _named(nodes, pairs)
    left = nodes.select(F.col("node").alias("a"), *[F.col(f).alias(f"{f}_a") for f in fields])
    right = nodes.select(F.col("node").alias("b"), *[F.col(f).alias(f"{f}_b") for f in fields])
    joined = pairs.join(left, "a").join(right, "b")
    met = F.arrays_overlap("prefix2_a", "prefix2_b") & F.arrays_overlap("prefix3_a", "prefix3_b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    similar = common * (den + num) >= (F.col("n_a") + F.col("n_b")) * num
    return joined.select("a", "b", F.when(met, similar).otherwise(False).alias("links"))


def _different_lists(listed: DataFrame) -> DataFrame:
    """Lists of two nodes or more, and of those with the same nodes just one: they give the same pairs."""
    same = [F.count("*").alias("size"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2)]]
    lists = listed.groupBy("token").agg(*same).filter("size > 1")
    one = lists.groupBy("size", "x1", "x2").agg(F.min("token").alias("token")).select("token")
    return listed.join(one, "token")


def _open_lists(listed: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of lists that hold several components, with ``label``, the list's ``size``, and ``minors``: those outside its largest."""
    labelled = listed.join(labels, "node")
    per_label = labelled.groupBy("token", "label").agg(F.count("*").alias("size"))
    lists = per_label.groupBy("token").agg(
        F.max_by("label", F.struct("size", "label")).alias("major"), F.count("*").alias("labels"),
        F.sum("size").alias("size"), (F.sum("size") - F.max("size")).alias("minors"),
    )
    some = lists.filter("labels > 1").select("token", "major", "size", "minors")
    return labelled.join(some, "token").select("token", "node", "label", "size", "minors", (F.col("label") != F.col("major")).alias("minor"))


def _placed(rows: DataFrame, turn: int) -> DataFrame:
    """The block (``x, y``) of each row of a list; from ``BLOCK_ROUNDS`` on minor rows also visit all blocks."""
    blocks = F.ceil(F.col("size") / LIMIT).cast("int")
    home = F.pmod(F.xxhash64("node", F.lit(turn)), blocks).cast("int")
    if turn < BLOCK_ROUNDS:
        return rows.withColumns({"x": F.lit(0), "y": home})
    parties = F.greatest(F.ceil(F.col("minors") / LIMIT).cast("int"), F.lit(1))
    party = F.pmod(F.xxhash64("node", F.lit(-1 - turn)), parties).cast("int")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    stays = F.transform(F.sequence(F.lit(0), parties - 1), lambda i: at(i, home))
    visits = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: at(party, i))
    places = F.when(blocks == 1, F.array(at(F.lit(0), F.lit(0)))).when(F.col("minor"), F.concat(stays, visits)).otherwise(stays)
    return rows.withColumn("at", F.explode(places)).select("*", "at.x", "at.y").drop("at")


def _forest(label: np.ndarray, node: np.ndarray, n: np.ndarray, lonely: np.ndarray, bits: np.ndarray, tried: list[tuple[int, np.ndarray]], times: int, num: int, den: int) -> list[tuple[int, int]]:
    """Edges of ``times`` least spanning forests (one after the other) of the close pairs between components.

    Close: the sizes allow the similarity, the second and third order's maps meet, and the tokens known to be
    of one of both only (those of no other node, and the sketch's buckets of different parity) are few enough.
    """
    m = len(label)
    found, of, sizes = np.unique(label, return_inverse=True, return_counts=True)
    if len(found) == 1:
        return []
    minors = np.flatnonzero(of != np.argmax(sizes))  # pairs within the largest component are not looked for
    cost = np.full((m, m), np.inf, np.float32)
    sketch, second, third = bits[:, :SKETCH_WORDS], bits[:, SKETCH_WORDS : SKETCH_WORDS + MAP_WORDS], bits[:, SKETCH_WORDS + MAP_WORDS :]
    for a in range(0, len(minors), 64):
        own = minors[a : a + 64]
        apart = np.bitwise_count(sketch[own, None] ^ sketch[None]).sum(axis=2, dtype=np.int64) + lonely[own, None] + lonely[None]
        close = apart * (den + num) <= (n[own, None] + n[None]) * (den - num)
        close &= np.minimum(n[own, None], n[None]) * den >= np.maximum(n[own, None], n[None]) * num
        close &= (second[own, None] & second[None]).any(axis=2) & (third[own, None] & third[None]).any(axis=2)
        near = np.where(close, apart, np.inf)
        cost[own], cost[:, own] = near, near.T
    for i, others in tried:
        where = np.flatnonzero(np.isin(node, others))
        cost[i, where] = cost[where, i] = np.inf
    same = of[:, None] == of[None]
    cost[same] = np.inf
    if not np.isfinite(cost).any():
        return []
    cost[same] = -1
    edges: list[tuple[int, int]] = []
    for _ in range(times):
        best, by, left = np.full(m, np.inf, np.float32), np.zeros(m, np.int64), np.ones(m, bool)
        new: list[tuple[int, int]] = []
        for _ in range(m):
            i = int(np.argmin(np.where(left, best, np.float32(3e38))))
            if not left[i]:
                i = int(np.argmax(left))
            if 0 <= best[i] < np.inf:
                new.append((i, int(by[i])))
            left[i] = False
            nearer = left & (cost[i] < best)
            best[nearer], by[nearer] = cost[i][nearer], i
        for i, j in new:
            cost[i, j] = cost[j, i] = np.inf
        edges += new
        if not new:
            break
    return edges


def _pairs(times: int, num: int, den: int) -> Callable:
    """Pairs to try from rows ``token, x, y, node, label, n, lonely, bits, tried`` in order of the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def worked(rows: pa.RecordBatch) -> pa.RecordBatch:
            keys = [rows.column(i).to_numpy() for i in range(3)]
            differs = np.zeros(len(rows) - 1, bool)
            for k in keys:
                differs |= k[1:] != k[:-1]
            bounds = np.flatnonzero(np.concatenate([[True], differs, [True]]))
            node, label = (_unfixed(rows.column(i), NODE, 16)[:, 0] for i in (3, 4))
            n, lonely = rows.column(5).to_numpy(), rows.column(6).to_numpy()
            bits = _unfixed(rows.column(7), np.uint64, 8 * (SKETCH_WORDS + 2 * MAP_WORDS))
            some = rows.column(8).value_lengths().fill_null(0).to_numpy() > 0
            left, right, of = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                mine = np.arange(a, b)
                if b - a > 2:
                    mine = mine[np.sort(np.unique(node["a"][mine], return_index=True)[1])]
                tried = [(i, np.array([int.from_bytes(t[:8], "little") for t in rows.column(8)[int(at)].as_py()], np.uint64)) for i, at in enumerate(mine) if some[at]]
                for i, j in _forest(label["a"][mine], node["a"][mine], n[mine], lonely[mine], bits[mine], tried, times, num, den):
                    left.append(mine[i])
                    right.append(mine[j])
                    of.append(keys[0][a])
            ends = [_fixed(node[np.array(x, np.int64)]) for x in (left, right)]
            return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *ends], names=["token", "a", "b"])

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            if not len(batch):
                continue
            last = [c[len(batch) - 1] for c in batch.columns[:3]]
            same = [c.to_numpy() == v.as_py() for c, v in zip(batch.columns[:3], last, strict=True)]
            begun = int(np.argmax(same[0] & same[1] & same[2]))  # the last group goes on in the next batch
            if begun:
                held.append(batch.slice(0, begun))
                yield worked(joined())
                held = []
            elif held and any(held[-1].column(i)[0].as_py() != v.as_py() for i, v in enumerate(last)):
                yield worked(joined())
                held = []
            held.append(batch.slice(begun))
        if held:
            yield worked(joined())
        release()

    return run


def _candidates(rows: DataFrame, nodes: DataFrame, tried: DataFrame | None, turn: int, num: int, den: int) -> DataFrame:
    """Pairs ``a < b`` to try in this round, with the list (``token``) they come from."""
    placed = _placed(rows, turn).select("token", "x", "y", "node", "label").join(nodes.select("node", "n", "lonely", "bits"), "node")
    if tried is None:
        full = placed.withColumn("tried", F.expr("CAST(NULL AS array<binary>)"))
    else:
        both = tried.union(tried.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("tried"))
        full = placed.join(both, "node", "left")
    keyed = full.select("token", "x", "y", "node", "label", "n", "lonely", "bits", "tried").repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    pairs = keyed.mapInArrow(_pairs(2**turn, num, den), "token long, a binary, b binary")
    return pairs.select("token", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after the components that edges join have become one."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    between = edges.join(side("a"), "a").join(side("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = components(between.filter("a != b")).withColumnRenamed("label", "joined")
    return cut(
        labels.join(joined.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("joined", "label").alias("label"))
    )


def _verdict(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Per row ``doc_id, key (xxhash64 of the text), n``, the ``label`` of its component (null: an empty set) and ``component_id``."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    sets = cut(slim.mapInArrow(_sets(k), "doc_id long, key long, node binary, n long"))
    total = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(parallelism(spark), total // PART_TOKENS)
    moved = slim.select("text").mapInArrow(_tokens(k, parts), _BLOCK).repartitionById(parts, "part")
    back = moved.mapInArrow(_shared(parts), _BLOCK).repartitionById(parts, "part")
    nodes = _once(materialise(back.mapInArrow(_survivors(num, den), _NODES), "jaccard-nodes"))

    listed = cut(_different_lists(nodes.select("node", F.explode("prefix").alias("token"))))
    labels = nodes.select("node", F.col("node").alias("label"))
    tried: list[DataFrame] = []
    turn = 0
    while True:
        rows = cut(_open_lists(listed, labels))
        if rows.isEmpty():
            break
        failed = reduce(DataFrame.union, tried) if tried else None
        found = cut(_candidates(rows, nodes, failed, turn, num, den))
        tested = cut(_tested(cut(found.select("a", "b").distinct()), nodes, num, den))
        told = {r["links"]: r["n"] for r in tested.groupBy("links").agg(F.count("*").alias("n")).collect()}
        if told.get(False):
            tried.append(tested.filter("NOT links").select("a", "b"))
        if told.get(True):
            labels = _merged(labels, tested.filter("links").select("a", "b"))
        # A list all whose blocks met without a pair to try never has one again: labels only join, and tries only add up.
        going = rows.join(found.select("token").distinct(), "token", "left_semi")
        if turn < BLOCK_ROUNDS:
            going = going.union(rows.filter(F.col("size") > LIMIT)).distinct()
        listed = going.select("token", "node")
        turn = turn + 1 if told else max(turn + 1, BLOCK_ROUNDS)

    classes = sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = classes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    smallest = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    verdict = placed.join(smallest, "label").select("node", "label", "component_id")
    full = sets.filter("n > 0").join(verdict, "node").select("doc_id", "key", "n", "label", "component_id")
    empty = sets.filter("n = 0").select("doc_id", "key", "n", F.lit(None).cast("binary").alias("label"), F.col("doc_id").alias("component_id"))
    return full.union(empty)


def linked_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100
) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id``."""
    return _verdict(docs, id_col, text_col, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100
) -> DataFrame:
    """Just one row of each component, with all its columns: of the rows with the smallest id (null is the largest) and
    then text hash, one.  Rows with an empty set link with nothing and all stay.
    """
    rows = _verdict(docs, id_col, text_col, k, num, den).filter("n > 0").groupBy("doc_id", "key", "label").agg(F.count("*").alias("times"))
    rows = cut(rows)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    best = rows.groupBy("label").agg(F.min_by(F.struct("doc_id", "key", "times"), order).alias("best")).select("best.*")
    best = cut(best)
    rid, rkey, own = (fresh(c, docs.columns) for c in ("rid", "rkey", "own_key"))
    named = lambda frame: frame.select(F.col("doc_id").alias(rid), F.col("key").alias(rkey))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(rid)) & (F.xxhash64(text_col) == F.col(rkey))
    alone = named(best.filter("times = 1"))
    gone = named(rows.select("doc_id", "key")).exceptAll(alone)
    kept = docs.join(gone, same, "left_anti")
    repeated = named(best.filter("times > 1"))
    if repeated.isEmpty():
        return kept
    again = docs.join(repeated, same, "left_semi").withColumns({rid: F.col(id_col).cast("long"), own: F.xxhash64(text_col)})
    return kept.union(again.dropDuplicates([rid, own]).drop(rid, own))
