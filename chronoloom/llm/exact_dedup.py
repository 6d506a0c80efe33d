"""Exact deduplication by a Grace hash join of the table with itself.

1. Each task puts the rows it reads into an open-addressing table keyed by the complete content,
   and writes one *local representative* per distinct content, with its number of rows and its
   largest id.  A table that outgrows ``table_bytes`` is written out and begun anew, so one
   content held by a third of all rows shrinks to one representative per table.
2. The representatives are partitioned by the leading bits of a content hash.  Buckets are weighed, those
   of several contents above ``bucket_bytes`` are partitioned again by further bits, and what comes of them is weighed
   again, until each fits or all bits are used.  Of a bucket of one content a table keeps one copy.
   The shuffle files of that partitioning are Grace's spill files.
3. Each bucket goes through an open-addressing table of its own that compares complete contents, which
   numbers the groups; the numbers return to the rows by their representative.

Defined results: null text counts as empty; a null id is smaller than any other (a group of null
ids only has a null ``keep_id``); of equal texts the row with the largest id stays, of rows that
repeat that id just one; a very long text is one content, held whole a few times over in its task; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, materialise, parallelism, release

_LOCAL = "doc_id long, text_sha256 string, rep long, best boolean, content binary, hash long, rows long, max_id long"
_LEAST = -(2**63)


def _local(table_bytes: int, carry: bool):
    """Rows with their local representative; the representative's own row carries the content.

    With ``carry`` a third column is handed through as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, 0
        table: dict[bytes, int] = {}
        groups: list[list] = []  # rows, max id, position of the row with it
        ids: list = []
        reps: list[int] = []
        shas: list[str] = []
        carried: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal table, groups, ids, reps, shas, size, made, carried
            n = len(ids)
            contents: list = [None] * n
            hashes: list = [None] * n
            rows: list = [None] * n
            most: list = [None] * n
            best = [False] * n
            for content, g in table.items():
                count, top, at = groups[g]
                digest = hashlib.blake2b(content, digest_size=8).digest()
                contents[at], rows[at], best[at] = content, count, True
                hashes[at] = int.from_bytes(digest, "big", signed=True)
                most[at] = None if top == _LEAST else top
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(shas, pa.string()),
                    pa.array([base + made + r for r in reps], pa.int64()), pa.array(best, pa.bool_()),
                    pa.array(contents, pa.binary()), pa.array(hashes, pa.int64()),
                    pa.array(rows, pa.int64()), pa.array(most, pa.int64()), *([pa.concat_arrays(carried)] if carry else []),
                ],
                names=[f.split()[0] for f in _LOCAL.split(", ")] + ["payload"] * carry,
            )
            made += len(groups)
            table, groups, ids, reps, shas, carried, size = {}, [], [], [], [], [], 0
            return out

        for batch in batches:
            begun = 0
            for at, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                content = (text.as_py() or "").encode()
                g = table.get(content)
                rank = _LEAST if doc is None else doc
                if g is None:
                    g = table[content] = len(groups)
                    groups.append([1, rank, len(ids)])
                    size += len(content) + 200
                    shas.append(hashlib.sha256(content).hexdigest())
                else:
                    group = groups[g]
                    group[0] += 1
                    shas.append(shas[group[2]])
                    if rank > group[1]:
                        group[1], group[2] = rank, len(ids)
                size += 120
                ids.append(doc)
                reps.append(g)
                if size >= table_bytes:
                    if carry:
                        carried.append(batch.column(2).slice(begun, at + 1 - begun))
                        begun = at + 1
                    yield flush()
            if carry and begun < len(batch):
                carried.append(batch.column(2).slice(begun))
        if ids:
            yield flush()
        release()

    return run


def _prefix() -> Column:
    return F.expr("shiftrightunsigned(hash, 64 - bits)")


def _buckets(reps: DataFrame, bucket_bytes: int, least: int) -> tuple[DataFrame, int]:
    """The representatives with ``bits, prefix`` of their bucket, and a number of partitions for them."""
    total = reps.agg(F.sum(F.length("content") + 64)).first()[0] or 0
    parts = max(least, math.ceil(2 * total / bucket_bytes))
    placed = reps.withColumn("bits", F.lit(max(1, math.ceil(math.log2(parts)))))
    for _ in range(16):  # 4 more bits each time
        weighed = placed.groupBy("bits", _prefix().alias("prefix")).agg(
            F.sum(F.length("content") + 64).alias("bytes"), F.min("hash").alias("one"), F.max("hash").alias("other")
        )
        over = cut(weighed.filter((F.col("bytes") > bucket_bytes) & (F.col("one") != F.col("other")) & (F.col("bits") < 60)))
        if over.isEmpty():
            break
        over = over.select(F.col("bits").alias("over_bits"), F.col("prefix").alias("over"))  # at most total / bucket_bytes rows; Spark sees their size
        placed = placed.join(over, (F.col("bits") == F.col("over_bits")) & (_prefix() == F.col("over")), "left")
        placed = placed.withColumn("bits", F.when(F.col("over").isNotNull(), F.least(F.col("bits") + 4, F.lit(60))).otherwise(F.col("bits"))).drop("over_bits", "over")
    return placed.withColumn("prefix", _prefix()), parts


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Global groups of the representatives by complete content, bucket by bucket (``bits, prefix``, in order)."""
    table: dict[bytes, int] = {}
    reps: list[int] = []
    group_of: list[int] = []
    rows: list[int] = []
    best: list[tuple[int, int]] = []
    bucket = None

    def flush() -> pa.RecordBatch:
        at = np.array(group_of)
        tops = np.array([b[0] for b in best])
        winners = np.array([-b[1] for b in best])
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(reps, pa.int64()),
                pa.array(tops[at], pa.int64(), mask=tops[at] == _LEAST),
                pa.array(np.array(rows)[at], pa.int64()),
                pa.array(winners[at] == np.array(reps)),
            ],
            names=["rep", "keep_id", "group_size", "wins"],
        )
        for held in (table, reps, group_of, rows, best):
            held.clear()
        return out

    for batch in batches:
        keys = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
        columns = [batch.column(i) for i in range(4)]
        for key, rep, content, count, top in zip(
            keys, columns[0].to_pylist(), columns[1], columns[2].to_pylist(), columns[3].to_pylist(), strict=True
        ):
            if key != bucket and reps:
                yield flush()
            bucket = key
            g = table.setdefault(content.as_py(), len(rows))
            rank = (_LEAST if top is None else top, -rep)
            if g == len(rows):
                rows.append(count)
                best.append(rank)
            else:
                rows[g] += count
                best[g] = max(best[g], rank)
            reps.append(rep)
            group_of.append(g)
    if reps:
        yield flush()
    release()


def _grace(slim: DataFrame, table_bytes: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their representatives, and the representatives' groups."""
    carry = "payload" in slim.columns
    schema = f"{_LOCAL}, payload {slim.schema['payload'].dataType.simpleString()}" if carry else _LOCAL
    local = materialise(slim.mapInArrow(_local(table_bytes, carry), schema), "exact-dedup")
    reps = local.filter("best")
    placed, n = _buckets(reps.select("rep", "content", "rows", "max_id", "hash"), bucket_bytes, parallelism(slim.sparkSession))
    groups = (
        placed.select("rep", "content", "rows", "max_id", "bits", "prefix")
        .repartition(n, "bits", "prefix")
        .sortWithinPartitions("bits", "prefix")
        .mapInArrow(_group, "rep long, keep_id long, group_size long, wins boolean")
    )
    return local, groups


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    table_bytes: int = 16 << 20,
    bucket_bytes: int = 32 << 20,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``table_bytes`` bounds a task's first table, ``bucket_bytes`` a bucket's representatives.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    local, groups = _grace(slim, table_bytes, bucket_bytes)
    return local.select("doc_id", "text_sha256", "rep", "best").join(groups, "rep").select(
        "doc_id", "keep_id", "group_size", (F.col("best") & F.col("wins")).alias("kept"), "text_sha256"
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    table_bytes: int = 16 << 20,
    bucket_bytes: int = 32 << 20,
) -> DataFrame:
    """The one row of each group that stays, with all its columns as they were."""
    others = [c for c in docs.columns if c != text_col]
    payload = F.struct(F.col(text_col).isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), payload.alias("payload"))
    local, groups = _grace(slim, table_bytes, bucket_bytes)
    stays = local.filter("best").join(groups.filter("wins").select("rep"), "rep", "left_semi")
    text = F.when(~F.col("payload.none"), F.decode("content", "UTF-8")).alias(text_col)
    return stays.select(*[text if c == text_col else F.col(f"payload.c{others.index(c)}").alias(c) for c in docs.columns])
