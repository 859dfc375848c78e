"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64 bits of majority over the XXH64 of a text's word shingles.
For each distinct fingerprint a table holds its Hamming distances to reference
fingerprints: 0 and, for each pair of neighbouring bits, the one with just
these two bits. By the triangle inequality the distances of two fingerprints
within k bits differ by at most k in every coordinate; pairs beyond that are
discarded and the rest is verified.

Which pairs meet at all follows from the same table: (d(x, 0) - d(x, p) + 2) / 2
is the number of bits x has in p's pair, and these numbers differ by k in sum
at most. With the pivots cut into k + 1 groups, linked fingerprints therefore
agree on one group, which is the cell they meet in. A cell with more than
BLOCK_ROWS rows is cut into blocks and every two blocks meet in a group of
their own, so no group is larger than two blocks. What leaves a group is a
spanning forest of its links, never all of them; components are then found in
Spark (``connected_components``).

Defined results: null and empty texts have fingerprint 0 and are linked like
others; a component's id is its smallest non-null doc_id (null if all are
null); every row gives one row, repeated rows too; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import free_names, hash_partitions, slices
from runledger.llm.components import connected_components
from runledger.session import through_parquet

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BLOCK_ROWS = 1024
PIVOTS = np.array([0] + [3 << (2 * j) for j in range(32)], dtype=np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; bytes.split() cuts at exactly the ASCII white space."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(line, SEED)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[:len(words) - shingle + 1].tolist()
        hashes = np.array([xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:].tolist())], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """The ``keep`` columns and the fingerprint as a bigint. Map-only."""
    keep = keep or ["doc_id"]
    at = len(keep)
    chosen = docs.select(*keep, F.col(text).alias(free_names(docs, "_text")[0]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t or "") for t in part.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(fps)], names=[*keep, name])

    return chosen.mapInArrow(run, schema)


def distances(fps: np.ndarray) -> np.ndarray:
    """Pivot table: one row per fingerprint, one column per pivot."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def cells(table: np.ndarray) -> list[np.ndarray]:
    """One key per group of pivots, from the distances alone."""
    bits = (table[:, :1] - table[:, 1:] + 2) // 2
    keys = []
    for g, cols in enumerate(np.array_split(np.arange(bits.shape[1]), MAX_BITS + 1)):
        key = np.full(len(bits), g, dtype=np.int64)
        for c in cols:
            key = key * 3 + bits[:, c]
        keys.append(key)
    return keys


def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        keys = cells(distances(fps.view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(fps, len(keys)))], names=["cell", "fp"])


def forest(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside the groups of equal ``group`` values (sorted)."""
    n = len(fps)
    code, table = fps.view(np.uint64), distances(fps.view(np.uint64))
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    left = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))) - np.arange(n) - 1
    out_u, out_v = [], []
    lag, at = 1, np.flatnonzero(left >= 1)
    while len(at):
        other = at + lag
        near = np.abs(table[at, 0] - table[other, 0]) <= MAX_BITS
        a, b = at[near], other[near]
        near = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= MAX_BITS
        a, b = a[near], b[near]
        near = np.bitwise_count(code[a] ^ code[b]) <= MAX_BITS
        for i, j in zip(a[near].tolist(), b[near].tolist()):
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out_u.append(i)
                out_v.append(j)
        lag += 1
        at = at[left[at] >= lag]
    return fps[np.array(out_u, dtype=np.int64)], fps[np.array(out_v, dtype=np.int64)]


def link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (cell, a, b, fp) rows to links; a group that a batch cuts is carried over."""
    rest = None
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]).astype(np.int64)
        rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
        fresh = np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])
        cut = np.flatnonzero(fresh)[-1]
        rest = rows[:, cut:]
        if cut:
            u, v = forest(np.ascontiguousarray(rows[3, :cut]), np.cumsum(fresh[:cut]))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
    if rest is not None:
        u, v = forest(np.ascontiguousarray(rest[3]), np.zeros(rest.shape[1]))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def links(fps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v) links that span the same components as all pairs within MAX_BITS; ``fps`` holds distinct fp values."""
    placed = fps.select("fp").mapInArrow(to_cells, "cell bigint, fp bigint")
    large = placed.groupBy("cell").count().where(F.col("count") > block_rows).select(
        F.col("cell").alias("_cell"), F.ceil(F.col("count") / block_rows).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meet = (placed.join(large, F.col("cell") == F.col("_cell"), "left")
            .select("cell", "fp", F.coalesce(F.col("parts"), F.lit(1)).alias("parts")).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp"))
    sorted_rows = meet.repartition(hash_partitions(fps.sparkSession), "cell", "a", "b").sortWithinPartitions("cell", "a", "b", "fp")
    return sorted_rows.mapInArrow(link_groups, "u bigint, v bigint")


def classes(marked: DataFrame) -> DataFrame:
    """(fp, component_id, root) of written (doc_id, fp) rows; root, a fingerprint, tells components of null ids apart."""
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(fps), "simhash")
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row."""
    marked = through_parquet(fingerprints(docs, text), "fingerprints")
    return marked.join(classes(marked), "fp").select("doc_id", "fp", "component_id")


def contract(docs: DataFrame) -> DataFrame:
    """The op7 contract."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that stay: of each component the one with the smallest doc_id (null ids last), all columns kept."""
    fp, n = free_names(docs, "_fp", "_n")
    # ids, fingerprints and text hashes decide; whole texts are read again for the winners only
    slim = through_parquet(fingerprints(docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("h")), keep=["doc_id", "h"]), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "h"))
    winners = slim.join(classes(slim.select("doc_id", "fp")).select("fp", "root").distinct(), "fp").groupBy("root").agg(first.alias("w")).select(
        F.col("w.doc_id").alias(fp), F.col("w.h").alias(n))
    kept = docs.join(winners, F.col("doc_id").eqNullSafe(F.col(fp)) & (F.xxhash64(text) == F.col(n)), "left_semi")
    # rows that repeat id and text are one document
    once = Window.partitionBy("doc_id", F.xxhash64(text)).orderBy(F.xxhash64(F.lit(1)))
    return kept.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(*docs.columns)
