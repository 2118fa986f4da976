"""Context-triggered piecewise hashing of whole documents, compared by edit distance."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bounds, ship, small_batches, table

WINDOW = 7
SMALLEST = 3
PIECES = 64
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: A run of this many pieces (a third of a shorter signature) has to agree before two signatures count as
#: alike; chance rarely gives one.
COMMON = 4


def _rolling(data: np.ndarray) -> np.ndarray:
    """For each position a hash of the last seven bytes: their sum, their sum weighted by place, and their
    XOR shifted by place. Bytes before the first are zero."""
    n = len(data)
    padded = np.concatenate((np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)))
    total, weighted, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for back in range(WINDOW):
        part = padded[WINDOW - 1 - back : WINDOW - 1 - back + n]
        total += part
        weighted += part * np.uint32(WINDOW - back)
        mixed ^= part << np.uint32(5 * back)
    return total + weighted + mixed


def fingerprint(text: str | None) -> str:
    """``block:signature:signature`` of a text's UTF-8 bytes. The block size is the smallest of 3, 6, 12, ...
    that expects at most 64 pieces; the signatures hold one letter per piece at that size and at twice it.
    A piece ends where the rolling hash of the last seven bytes is the block size less 1, modulo the block
    size; the last piece ends with the text. Null is taken as empty: ``3::``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    block = SMALLEST
    while block * PIECES < len(raw):
        block *= 2
    if not raw:
        return f"{block}::"
    h = _rolling(np.frombuffer(raw, np.uint8))
    signs = []
    for size in (block, 2 * block):
        ends = (np.flatnonzero(h % np.uint32(size) == size - 1) + 1).tolist()
        if not ends or ends[-1] != len(raw):
            ends.append(len(raw))
        at, out = 0, []
        for end in ends:
            out.append(LETTERS[(zlib.crc32(raw[at:end]) >> 13) & 63])
            at = end
        signs.append("".join(out))
    return f"{block}:{signs[0]}:{signs[1]}"


def _shrink(s: str) -> str:
    """Runs of more than three equal letters become three: they say little."""
    out = []
    for c in s:
        if out[-3:] != [c, c, c]:
            out.append(c)
    return "".join(out)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors, one integer step per letter of ``b``."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        eq = where.get(c, 0)
        x = eq | down
        eq |= ((eq & up) + up) ^ up
        plus = down | ~(eq | up) & full
        minus = up & eq
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus = plus << 1 & full | 1
        minus = minus << 1 & full
        up = minus | ~(x | plus) & full
        down = plus & x
    return distance


def _alike(a: str, b: str) -> float:
    a, b = _shrink(a), _shrink(b)
    if not a or not b:
        return 0.0
    k = max(1, min(COMMON, min(len(a), len(b)) // 3))
    grams = {a[i : i + k] for i in range(len(a) - k + 1)}
    if not any(b[i : i + k] in grams for i in range(len(b) - k + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1: one less the edit distance of the signatures over the longer one's length, at the best of
    the block sizes that the two fingerprints share; 0 if they share none. Equal fingerprints: 1."""
    if x == y:
        return 1.0
    p, a1, a2 = x.split(":")
    q, b1, b2 = y.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_alike(a1, b1), _alike(a2, b2))
    if p == 2 * q:
        return _alike(a1, b2)
    if q == 2 * p:
        return _alike(a2, b1)
    return 0.0


def edited(text: str | None, following: str | None) -> str:
    """The text with its last half replaced by as many first characters of the following one."""
    text, following = text or "", following or ""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("next_id", pa.int64()), ("edited", pa.string()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _walk(batches, with_text: bool):
    """Rows come sorted by bucket, then in the order of the walk; every row meets the one after it. The
    rows marked ``guest`` stand at their bucket's end and lend their text only."""
    last = first = None  # (bucket, doc_id, text, fingerprint)
    rows: list[tuple] = []

    def meet(a: tuple, b: tuple) -> None:
        changed = edited(a[2], b[2])
        mark = fingerprint(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        rows.append((a[1], len(a[2] or ""), b[1], changed if with_text else None, digest, a[3], mark, likeness(a[3], mark), likeness(a[3], b[3])))

    for batch in small_batches(batches):
        for bucket, guest, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            here = (bucket, doc, text, fingerprint(text))
            if last is not None and last[0] == bucket:
                meet(last, here)
                last = None if guest else here
            elif not guest:
                if last is not None:
                    meet(last, first)
                first = last = here
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)
            rows.clear()
    if last is not None:  # a bucket without a guest is the only one: its last row meets its first
        meet(last, first)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)


def neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 4096, with_text: bool = True) -> DataFrame:
    """Each document in descending order of its id beside the next one (the last beside the first):
    doc_id, n_chars, next_id, edited, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Without ``with_text``, edited is null, which spares moving it.

    Texts are shuffled once: quantiles of the ids (ids only are read for them) cut the order into buckets of
    about ``bucket_rows`` rows; the greatest id of each bucket goes to the bucket above it too, as a guest,
    so that no row needs another bucket. Each bucket is a task of its own. Only these quantiles reach the driver,
    8 bytes for ``bucket_rows`` rows.

    Null text is taken as empty. Rows that repeat an id stand in the order of their texts. Null ids come
    last. A single row is its own next. Very long texts are hashed whole. Ids are meant to be unique: rows that
    share one, or have none, stand in one bucket, which sorts by spilling and is walked as a stream, so it takes
    time but no memory. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bounds, _ = id_bounds(rows, bucket_rows)

    @F.pandas_udf("array<struct<bucket:int,guest:boolean>>")
    def places(ids: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for i, named in zip(ids, known):
            if not named or len(bounds) < 2:
                out.append([(0, False)])
                continue
            k = int(np.searchsorted(bounds, int(i)))
            out.append([(k, False)] + ([((k + 1) % len(bounds), True)] if bounds[k] == int(i) else []))
        return pd.Series(out)

    placed = rows.withColumn("at", F.explode(places(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNotNull()))).select("at.bucket", "at.guest", "doc_id", "text")
    dealt = placed.repartitionById(max(1, len(bounds)), "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")
    schema = "doc_id long, n_chars long, next_id long, edited string, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(lambda it: _walk(it, with_text), schema)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = neighbours(docs.select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
