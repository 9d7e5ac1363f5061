"""SimHash near-duplicates, with candidates by pigeonring chains.

A fingerprint has 64 bits in four segments that form a ring. If two fingerprints
differ in at most three bits, there is a segment from which every chain of l
consecutive segments differs in at most floor(3 l / 4) bits: none in the first, one in
the first two, two in the first three. The first two of these budgets make a join key
of 32 bits: the first segment as it is and the second with at most one bit cleared by
one of the two. The third budget is not applied: candidates that share a key go straight
to the full count, which is one operation on the whole 64 bits and decides alone.

Copies have one fingerprint and are one node. Rows that share a key form a run; a run
gives the links of a spanning forest of its near fingerprints, never all its pairs.
Runs are read in sorted order; keys with more than ``RUN`` fingerprints are cut into
chunks that meet pairwise in cells of a grid, so no task holds more than two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grid, pick, small_batches, stored
from .graph import components

SHINGLE = 3
BITS = 3
RUN = 20_000
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text as a signed 64-bit number; 0 without words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= SHINGLE:
        return int(np.uint64(digest(joined, 42)).astype(np.int64))
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    ends = ends[SHINGLE - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        some = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[at:at + BLOCK], ends[at:at + BLOCK])), np.uint64)
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(rows: DataFrame) -> DataFrame:
    """key, fp of every row of ``rows`` (key, text)."""
    @F.pandas_udf("long")
    def of(texts):
        return texts.map(fingerprint, na_action=None) if len(texts) else texts.astype("int64")

    return rows.select("key", of(F.coalesce("text", F.lit(""))).alias("fp"))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint four index rows, and a probe for each set bit of the second segment."""
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(4):
            first = (fps >> np.uint64(16 * start)) & np.uint64(0xFFFF)
            second = (fps >> np.uint64(16 * ((start + 1) % 4))) & np.uint64(0xFFFF)
            base = (np.uint64(start) << np.uint64(32)) | (first << np.uint64(16)) | second
            keys, owners, probes = [base], [fps], [np.zeros(len(fps), bool)]
            for bit in range(16):
                has = (second >> np.uint64(bit)) & np.uint64(1) == 1
                keys.append(base[has] ^ np.uint64(1 << bit))
                owners.append(fps[has])
                probes.append(np.ones(int(has.sum()), bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners).view(np.int64)),
                 pa.array(np.concatenate(probes))], ["k", "fp", "probe"])


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of all fingerprints (unsigned, different) within the distance."""
    links, left = [], fps
    while left.size > 1:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= BITS
            if near.any():
                links += [(x, y) for y in left[near]]
                todo += list(left[near])
                left = left[~near]
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal (k, cell), from rows sorted by both; the last run waits for the next batch."""
    def emit(k, cell, fp, probe):
        cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(cell) != 0)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(k)]
        indexed = np.add.reduceat(~probe, starts) if len(k) else np.zeros(0)
        links = []
        for a, b in zip(starts[(ends - starts > 1) & (indexed > 0)], ends[(ends - starts > 1) & (indexed > 0)]):
            links += forest(np.unique(fp[a:b]))
        got = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["u", "v"])

    kept = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "cell", "fp", "probe")]
        now[2] = now[2].view(np.uint64)
        if kept is not None:
            now = [np.concatenate(x) for x in zip(kept, now)]
        if not len(now[0]):
            continue
        last = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[-1] + 1) \
            if (now[0][0], now[1][0]) != (now[0][-1], now[1][-1]) else 0
        if last:
            yield emit(*[x[:last] for x in now])
        kept = [x[last:] for x in now]
    if kept is not None and len(kept[0]):
        yield emit(*kept)


def links(nodes: DataFrame, run: int = RUN) -> DataFrame:
    """u, v: links that join all of ``nodes`` (different fp) at ``BITS`` or fewer bits."""
    keys = nodes.select("fp").mapInArrow(_keys, "k long, fp long, probe boolean")
    cells = grid(keys, "k", "fp", run, keys.filter("NOT probe"))
    return cells.select("k", "cell", "fp", "probe").repartition("k", "cell").sortWithinPartitions("k", "cell") \
        .mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    component_id is the least key reachable over links of ``BITS`` or fewer bits. A
    null or wordless text has fingerprint zero and links like any other. A row with a
    null key takes part and belongs to its component, null if all its keys are. Repeated rows are copies. Empty
    tables give none.
    """
    small_batches(docs)
    rows = stored(fingerprints(pick(docs, key=key, text=text)), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("key").alias("first")), "fingerprint-classes")
    found = components(links(nodes, run))
    found = stored(found.union(found.select(F.col("label").alias("node"), "label").distinct()), "linked-classes")
    firsts = found.join(nodes, found["node"] == nodes["fp"]).groupBy("label").agg(F.min("first").alias("id"))
    linked = found.join(firsts, "label").select(F.col("node").alias("fp"), "id")
    classes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("id", "first").alias("id"))
    return rows.join(classes, "fp", "left").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("id").alias("component_id"))
