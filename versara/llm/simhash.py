"""Near-duplicate search on 64-bit SimHash fingerprints by segment popcounts."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_cuts, ship, small_batches, table, write_cut
from .graph import connected_components

#: Every second bit: the low bit of each two-bit segment.
LOW = 0x5555555555555555
#: Five runs of two-bit segments; two popcount vectors within Manhattan distance 2 agree on three of them.
RUNS = [(0, 14), (14, 28), (28, 40), (40, 52), (52, 64)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text: words are runs of bytes other than ASCII white space, A-Z lower-cased; a bit
    is 1 if it is set in over half of the shingles' XXH64 (seed 42), repeats counted. Fewer words than a
    shingle: the whole sequence is the shingle. No words (or null): 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, k = np.zeros(64, dtype=np.int64), n - shingle + 1
    for at in range(0, k, 1 << 15):
        to = min(k, at + (1 << 15))
        h = np.array([digest(flat[s:e], 42) for s, e in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > k, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of 64-bit hashes: a bit is 1 if it is set in over half of them."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches, shingle: int):
    for batch in small_batches(batches):
        out = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every document; other columns are ignored."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: Column) -> Column:
    """The popcounts of the 32 two-bit segments, each written as as many ones in its two bits. So the
    Manhattan distance of two vectors is the bit count of their XOR; it never exceeds the distance of the
    fingerprints."""
    half = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(half).bitwiseAND(F.lit(LOW))
    both = fp.bitwiseAND(half).bitwiseAND(F.lit(LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def within(a: Column, b: Column, distance: int) -> Column:
    """Whether two fingerprints differ in ``distance`` bits or fewer, by their embeddings' Manhattan distance first."""
    return (F.bit_count(embedding(a).bitwiseXOR(embedding(b))) <= distance) & (F.bit_count(a.bitwiseXOR(b)) <= distance)


def _cells(fps: DataFrame) -> DataFrame:
    """``(side, cell, fp, e)``: the embedding's grid cell under each choice of three runs of five. Two
    vectors at Manhattan distance 2 or less differ in two runs at most, and so share a cell."""
    masks = []
    for some in combinations(RUNS, 3):
        bits = reduce(lambda m, r: m | (((1 << (r[1] - r[0])) - 1) << r[0]), some, 0)
        masks.append(_signed(bits))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)]))
    return fps.select("fp", embedding(F.col("fp")).alias("e")).select(at.alias("at"), "fp", "e").select("at.side", "at.cell", "fp", "e")


def links(fps: DataFrame, *, distance: int = 2, cell_limit: int = 256) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints whose transitive closure is that of all pairs at
    ``distance`` (at most 2) or fewer differing bits. ``fps(fp)`` holds each fingerprint once.

    Cells of up to ``cell_limit`` fingerprints: the pairs of a cell whose Manhattan distance is in reach are
    verified exactly. Fuller cells (thousands of near copies): their fingerprints go through the exact
    neighbourhood of each instead, the fingerprint and its 64 one-bit changes; two fingerprints at distance
    2 or less meet in one of these, and all that meet there are within 2 of one another, so linking them to
    the smallest loses no link. Rows grow in proportion to the fingerprints in either way.
    """
    if distance not in (1, 2):
        raise ValueError("distance is 1 or 2; fingerprints at distance 0 are one node")
    cells = _cells(fps)
    sizes = write_cut(cells.groupBy("side", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
    dense = write_cut(cells.join(sizes, ["side", "cell"]), "dense")
    a = dense.where(F.col("n") <= cell_limit).select("side", "cell", F.col("fp").alias("a"), F.col("e").alias("ea"))
    b = dense.where(F.col("n") <= cell_limit).select("side", "cell", F.col("fp").alias("b"), F.col("e").alias("eb"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("ea").bitwiseXOR(F.col("eb"))) <= distance) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    pairs = a.join(b, ["side", "cell"]).where(near).select("a", "b")
    hot = dense.where(F.col("n") > cell_limit).select("fp").distinct()
    if not hot.head(1):
        return pairs
    changes = F.explode(F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)]))
    around = hot.select("fp", changes.alias("change")).select("fp", F.col("fp").bitwiseXOR(F.col("change")).alias("at"))
    if distance == 1:
        return pairs.union(around.join(hot.select(F.col("fp").alias("at")), "at").where("fp < at").select(F.col("fp").alias("a"), F.col("at").alias("b")))
    least = around.groupBy("at").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "a")
    meet = around.join(least, "at").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.union(meet)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: documents are linked where their fingerprints differ in
    ``distance`` bits or fewer, and component_id is the smallest doc_id reachable.

    Equal fingerprints are one node, so copies cost nothing after the first aggregation. Null and wordless
    texts have fingerprint 0 and are linked like any other. Null ids take part, but never name a component
    (null if a component has no other). Repeated rows come back as often; ties can't arise, as links are
    undirected. Very long texts are hashed whole, in blocks. Other columns are ignored, whatever their names.
    An empty table gives no rows. Cells over ``links``' ``cell_limit`` go another exact way, by which no link
    is lost.
    """
    prints = write_cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    nodes = write_cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(links(nodes.select("fp"), distance=distance))
    placed = write_cut(nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    many = write_cut(placed.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = write_cut(placed.select("fp", "root").join(many, "root").select("fp", "component_id"), "named")
    drop_cuts(nodes, placed, many)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
