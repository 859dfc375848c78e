"""Removal of repeated byte strings by a sparse suffix array, built in Spark.

Texts are UTF-8 bytes. Every byte covered by a SPAN-byte string that starts
anywhere else too is removed; matches never cross documents.

Sorting a suffix for each byte would move many times the input, so suffixes
start at anchors: the anchor of a SPAN-byte string is its smallest GRAM-byte
hash among the starts of its first half. It depends on the string alone, so
equal strings have their anchors at equal offsets, and the strings that share an
anchor are those with starts in one stretch before it. A suffix is known by its
leading token (the first bytes), the hash of the rest of its first REACH bytes,
and the hash of its zone, i.e. of all bytes of all its strings.

1. Sampled splitters deal the suffixes out by leading token, ties by the rest;
   a suffix class that fills several buckets is spread over them. Buckets are
   sorted by token, rest and zone (multikey: a later key decides among equals of
   the earlier ones). Neighbours that agree on token and rest are one class.
   Classes at splitters may have rows in several buckets, whatever their place
   in them, and are compared across buckets by counts.
2. Suffixes with an equal zone elsewhere repeat as a whole. Those of a class with
   several zones are compared string by string: their zones' bytes meet by class
   and all strings of a class are hashed and sorted. Classes of more than
   CLASS_ROWS zones are dealt out by string instead.
3. Covered stretches are merged per document and cut out.

Equality is decided on 64-bit hashes within a class, itself known by a 64-bit
hash and the leading token. Defined results: null and empty texts have no bytes;
shorter texts than SPAN lose nothing; repeated rows are documents of their own,
so they repeat each other; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import hash_partitions
from runledger.session import through_parquet

SPAN, GRAM = 200, 16
HALF = SPAN // 2
REACH = SPAN - (HALF - GRAM)
CLASS_ROWS = 20_000
# documents whose suffixes are sampled for splitters, and one in how many of their suffixes
SAMPLE_DOCS, SAMPLE_EVERY = 4000, 4
CHUNK_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashed:
    """Concatenated texts with hashes of any stretch of 8 or more bytes."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        self.words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (n + 8, 8), (1, 1))).view("<u8").ravel()
        self.token = mix(self.words[:n] + ODD)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, ODD)]))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BACK)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.token * powers[:n])])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end - 7] - self.sums[start]) * self.back[start])


def suffixes(text: Hashed, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, first and last string start, and text number of every suffix of the concatenated texts."""
    n = len(raw)
    after = text.token[np.minimum(np.arange(n) + 8, n - 1)]
    key = (mix(text.words[:n] * ODD ^ after) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width, step, low = HALF - GRAM + 1, 1, key
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:len(low) - (width - step)], low[width - step:])
    starts = np.flatnonzero(np.arange(n) + SPAN <= np.repeat(bounds[1:], np.diff(bounds)))
    anchor = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])) if len(starts) else starts
    last = starts[np.append(new[1:], len(starts)) - 1] if len(starts) else starts
    return anchor[new], starts[new], last, owner[new]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of texts of about CHUNK_BYTES."""
    encoded = [t.encode("utf-8", "replace") if t else b"" for t in texts.to_pylist()]
    at = 0
    while at < len(encoded):
        end, size = at + 1, len(encoded[at])
        while end < len(encoded) and size + len(encoded[end]) <= CHUNK_BYTES:
            size += len(encoded[end])
            end += 1
        yield at, np.frombuffer(b"".join(encoded[at:end]), np.uint8), np.cumsum([0, *map(len, encoded[at:end])])
        at = end


PACK = 1 << 8


def packed(anchor, first, last):
    """One number for a suffix: anchor, and how far before it its strings start."""
    return (anchor * PACK + (anchor - first)) * PACK + (anchor - last)


def unpacked(ref):
    """(anchor, farthest, nearest) of a packed suffix."""
    return ref // (PACK * PACK), ref // PACK % PACK, ref % PACK


def leading_of(lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What splitters are compared with: token and the top half of the rest, unsigned."""
    return (lead.view(np.uint64) << np.uint64(32)) | (rest.view(np.uint64) >> np.uint64(32))


def emit(splitters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for at, raw, bounds in chunks(batch.column(1)):
                if len(raw) < SPAN:
                    continue
                text = Hashed(raw)
                anchor, first, last, owner = suffixes(text, raw, bounds)
                lead = text.words[anchor].byteswap() >> np.uint64(32)
                rest = text.stretch(anchor + 4, anchor + REACH)
                zone = text.stretch(first, last + SPAN) ^ mix(packed(anchor, first, last).astype(np.uint64) % np.uint64(PACK * PACK))
                doc = keys[at + owner]
                leading = leading_of(lead, rest)
                low = np.searchsorted(splitters, leading, side="left")
                ways = np.searchsorted(splitters, leading, side="right") - low + 1
                tie = mix(zone ^ doc.view(np.uint64)) >> np.uint64(8)
                bucket = low + (tie % ways.astype(np.uint64)).astype(np.int64)
                ref = packed(anchor - bounds[owner], first - bounds[owner], last - bounds[owner])
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket.astype(np.int32)), pa.array(lead.astype(np.int64)), pa.array(rest.view(np.int64)),
                    pa.array(zone.view(np.int64)), pa.array(doc), pa.array(ref)], names=["bucket", "lead", "rest", "zone", "d", "ref"])
    return run


SUFFIX = "bucket int, lead bigint, rest bigint, zone bigint, d bigint, ref bigint"
JUDGED = "d bigint, ref bigint, class bigint, zones bigint, whole boolean, partner boolean, lead bigint, rest bigint, zone bigint, n bigint, edge boolean"


def judge(rows: np.ndarray, edge: np.ndarray) -> pa.RecordBatch | None:
    """Sorted suffixes (lead, rest, zone, d, ref) of complete classes to those that repeat; of an edge class one row per zone is left open."""
    lead, rest, zone, d, ref = rows
    new_class = np.concatenate([[True], (lead[1:] != lead[:-1]) | (rest[1:] != rest[:-1])])
    new_zone = new_class | np.concatenate([[True], zone[1:] != zone[:-1]])
    cls, zn = np.cumsum(new_class) - 1, np.cumsum(new_zone) - 1
    size, zone_size = np.bincount(cls)[cls], np.bincount(zn)[zn]
    zones = np.bincount(cls[new_zone])[cls]
    whole, partner = zone_size >= 2, new_zone & (zone_size >= 2) & (zones >= 2)
    # at a boundary one row speaks for its zone, the others repeat it anyway
    keep, open_ = np.flatnonzero((size >= 2) | edge), edge & new_zone
    if len(keep) == 0:
        return None
    ident = mix(rest.view(np.uint64) ^ mix(lead.view(np.uint64))).view(np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(d[keep]), pa.array(ref[keep]), pa.array(ident[keep]), pa.array(zones[keep]), pa.array(whole[keep]), pa.array((partner & ~edge)[keep]),
        *[pa.array(x[keep], mask=~open_[keep]) for x in (lead, rest, zone, zone_size)], pa.array(open_[keep])],
        names=[c.split()[0] for c in JUDGED.split(", ")])


def judge_bucket(splitters: np.ndarray):
    """Classes of one sorted bucket; those at a splitter, which other buckets may share, go on as edges."""
    def judged(rows: np.ndarray) -> pa.RecordBatch | None:
        rows = np.ascontiguousarray(rows)
        return judge(rows, np.isin(leading_of(rows[0], rows[1]), splitters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6)])
            rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
            if rows.shape[1] == 0:
                continue
            cut = np.flatnonzero(np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]))[-1]
            rest = rows[:, cut:]
            out = judged(rows[:, :cut]) if cut else None
            if out is not None:
                yield out
        out = judged(rest) if rest is not None and rest.shape[1] else None
        if out is not None:
            yield out
    return run


def across_boundaries(edges: DataFrame) -> DataFrame:
    """Judge the open rows of classes at splitters by counts over all buckets."""
    per_zone = edges.groupBy("lead", "rest", "zone").agg(F.sum("n").alias("n"), F.min(F.struct("d", "ref")).alias("least"))
    per_class = per_zone.groupBy("lead", "rest").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("zones"))
    facts = per_zone.join(per_class.where("rows >= 2"), ["lead", "rest"])
    joined = edges.select("d", "ref", "class", "lead", "rest", "zone").join(facts, ["lead", "rest", "zone"])
    partner = (F.col("n") >= 2) & (F.col("zones") >= 2) & (F.struct("d", "ref") == F.col("least"))
    return joined.select("d", "ref", "class", "zones", (F.col("n") >= 2).alias("whole"), partner.alias("partner"))


def cut_zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, text, wanted suffixes) to zones by class, or to single strings for very large classes."""
    for batch in batches:
        key, doc, ref, zone = [], [], [], []
        for d, text, wanted in zip(*[c.to_pylist() for c in batch.columns]):
            raw = text.encode("utf-8", "replace")
            large = None
            for w in wanted:
                p, far, near = unpacked(w["ref"])
                if w["zones"] <= CLASS_ROWS:
                    key.append(w["class"])
                    doc.append(d)
                    ref.append(w["ref"])
                    zone.append(raw[p - far:p - near + SPAN])
                else:
                    large = large or Hashed(np.frombuffer(raw, np.uint8))
                    for k, o in zip(string_keys(large, np.array([p]), np.array([far]), np.array([near]), np.array([w["class"]]))[0].tolist(), range(far, near - 1, -1)):
                        key.append(k)
                        doc.append(d)
                        ref.append(packed(p, p - o, p - o))
                        zone.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(ref, pa.int64()), pa.array(zone, pa.binary())],
                                         names=["key", "d", "ref", "zone"])


def string_keys(text: Hashed, p, far, near, cls) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of every string of the suffixes (class, offset and bytes), with the suffix's number and the offset, farthest first."""
    n = far - near + 1
    row = np.repeat(np.arange(len(p)), n)
    o = far[row] - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    start = p[row] - o
    hashed = text.stretch(start, start + SPAN)
    return mix(hashed ^ mix(cls[row].view(np.uint64) + o.astype(np.uint64))).view(np.int64), row, o


def match_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to the covered stretches of those strings that a class has twice."""
    def covered(key, doc, ref, zone) -> pa.RecordBatch:
        p, far, near = unpacked(ref)
        some = [i for i, z in enumerate(zone) if z is not None]
        keys, rows, offs = [], [], []
        if some:
            some = np.array(some)
            sizes = np.array([len(zone[i]) for i in some])
            begin = np.cumsum(sizes) - sizes
            text = Hashed(np.frombuffer(b"".join([zone[i] for i in some]), np.uint8))
            k, r, o = string_keys(text, begin + far[some], far[some], near[some], key[some])
            keys, rows, offs = [k], [some[r]], [o]
        bare = np.array([i for i, z in enumerate(zone) if z is None], dtype=np.int64)
        keys, rows, offs = np.concatenate([*keys, key[bare]]), np.concatenate([*rows, bare]), np.concatenate([*offs, far[bare]])
        _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
        hit = count[where] >= 2
        rows, offs = rows[hit], offs[hit]
        start = p[rows] - offs
        # strings of one suffix that start one after the other are one stretch
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (start[1:] != start[:-1] + 1)]) if len(rows) else np.zeros(0, dtype=bool)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(rows)) - 1 if len(at) else at
        return pa.RecordBatch.from_arrays([pa.array(doc[rows[at]]), pa.array(start[at]), pa.array(start[last] + SPAN)], names=["d", "start", "end"])

    rest = None
    for batch in batches:
        cols = [*[batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], batch.column(3).to_pylist()]
        if rest is not None:
            cols = [*[np.concatenate([a, b]) for a, b in zip(rest[:3], cols[:3])], rest[3] + cols[3]]
        if len(cols[0]) == 0:
            continue
        cut = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))[-1]
        if cut:
            yield covered(*[c[:cut] for c in cols])
        rest = [c[cut:] for c in cols]
    if rest is not None and len(rest[0]):
        yield covered(*rest)


def cut_out(doc_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, stretches in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                merged: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in stretches or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                at, out = 0, []
                for s, e in merged:
                    out.append(raw[at:s])
                    at = e
                sizes.append(len(raw))
                spans.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join([*out, raw[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "removed", "kept"])
    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) per row: removed is the list of (start, end) byte runs, kept the other bytes."""
    spark = docs.sparkSession
    named = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("d"))
    texts = named.where(F.octet_length("text") >= SPAN).select("d", "text")
    parts = hash_partitions(spark)
    modulus = max(1, texts.count() // SAMPLE_DOCS)
    sample = texts.where(F.pmod("d", F.lit(modulus)) == 0).mapInArrow(emit(np.zeros(0, np.uint64)), SUFFIX).where(
        F.pmod(F.xxhash64("ref", "d"), F.lit(SAMPLE_EVERY)) == 0)
    seen = np.sort(np.array([((r["lead"] & 0xFFFFFFFF) << 32) | (r["rest"] & (1 << 64) - 1) >> 32 for r in sample.select("lead", "rest").collect()], dtype=np.uint64))
    splitters = seen[np.linspace(0, len(seen) - 1, parts + 1).astype(int)[1:-1]] if len(seen) else seen
    dealt = texts.mapInArrow(emit(splitters), SUFFIX).repartitionById(parts, "bucket").sortWithinPartitions("lead", "rest", "zone", "d", "ref")
    judged = through_parquet(dealt.mapInArrow(judge_bucket(splitters), JUDGED), "suffixes")
    rows = judged.where("not edge").select("d", "ref", "class", "zones", "whole", "partner").unionByName(across_boundaries(judged.where("edge")))
    rows = through_parquet(rows, "suffix-classes")
    wanted = rows.where("partner or (not whole and zones >= 2)").groupBy("d").agg(F.collect_set(F.struct("ref", "class", "zones")).alias("wanted"))
    # a row that comes twice gives its zones twice, and all its strings do repeat
    zones = texts.join(wanted, "d").mapInArrow(cut_zones, "key bigint, d bigint, ref bigint, zone binary")
    strings = zones.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(match_strings, "d bigint, start bigint, end bigint")
    p, far, near = F.floor(F.col("ref") / (PACK * PACK)), F.floor(F.col("ref") / PACK) % PACK, F.col("ref") % PACK
    whole = rows.where("whole").select("d", (p - far).alias("start"), (p - near + SPAN).alias("end"))
    stretches = whole.unionByName(strings).groupBy("d").agg(F.collect_set(F.struct("start", "end")).alias("stretches"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return named.join(stretches, "d", "left").select("doc_id", "text", "stretches").mapInArrow(
        cut_out(doc_type), f"doc_id {doc_type}, n_bytes bigint, removed array<struct<start: bigint, end: bigint>>, kept binary")


def contract(docs: DataFrame) -> DataFrame:
    """The op9 contract."""
    n = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return remove_repeats(docs).select("doc_id", "n_bytes", n.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                                       F.sha2("kept", 256).alias("kept_sha256"))
