"""Packing documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, small_batches, table, tokenizer_path
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, recut boolean, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("recut", pa.bool_()), ("ids", pa.binary())])


class SumOfSquares:
    """Places items of 1..window-1 tokens online. ``levels[h]`` counts the open windows filled to h; an
    item goes to the level whose choice leaves the least sum of squared counts (ties: the fullest). At most
    ``most_open`` windows are open: when the rule would open another, the item goes whole to the best open
    level that has room for it, or, if none has, it is cut where it fills a window, by the same rule, and the
    rest of it is placed as an item of its own."""

    def __init__(self, window: int, most_open: int) -> None:
        self.window, self.most_open = window, most_open
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list] = {}
        self.count = 0

    def level(self, size: int) -> int:
        """The level for an item: 0 opens a window. Squares change by 2(N[h+s] - N[h]) + 2 if a window
        moves from h to h+s, by 1 - 2 N[h] if it closes, by 2 N[s] + 1 if one opens. -1: no window may be opened
        and none has room."""
        n, last = self.levels, self.window - size
        change = 2 * (n[size : self.window + 1] - n[: last + 1]) + 2
        change[last] = 1 - 2 * n[last]
        change[0] = 2 * n[size] + 1
        usable = n[: last + 1] > 0
        usable[0] = self.count < self.most_open
        if not usable.any():
            return -1
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return int(last - np.argmin(change[::-1]))

    def level_to_fill(self) -> int:
        """The open level to close by a cut: closing one of N[h] windows changes the squares by 1 - 2 N[h], so
        the commonest level (ties: the fullest)."""
        return int(self.window - np.argmax(self.levels[::-1]))

    def place(self, size: int, item, new_window) -> list | None:
        """Puts a whole item; returns the window if that filled it. A window is a list [id, filled, items]."""
        return self._put(self.level(size), size, item, new_window)

    def _put(self, h: int, size: int, item, new_window) -> list | None:
        if h:
            w = self.open[h].pop()
            self.levels[h] -= 1
            self.count -= 1
        else:
            w = new_window()
        w[2].append(item)
        w[1] += size
        if w[1] == self.window:
            return w
        self.levels[w[1]] += 1
        self.count += 1
        self.open.setdefault(w[1], []).append(w)
        return None

    def place_cut(self, ids: np.ndarray, make, new_window) -> list:
        """Puts an item of ids, cut if it has to be; ``make(a, b)`` gives the item of ids a to b. Returns the
        windows that this filled."""
        full, at = [], 0
        while at < len(ids):
            size = len(ids) - at
            h = self.level(size)
            if h < 0:
                h = self.level_to_fill()
                size = self.window - h
            if w := self._put(h, size, make(at, at + size), new_window):
                full.append(w)
            at += size
        return full

    def drain(self) -> list:
        """All open windows, the fullest first."""
        out = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open.clear()
        self.levels[:] = 0
        self.count = 0
        return out


def finish(windows: list, window: int, new_window) -> list:
    """Closes the windows that are open at a partition's end, the fullest first: items of the emptiest ones are
    moved to the fullest until these are full, so that all but the last are; that one is cut into sequences whose
    lengths are powers of two. Items are (doc, start, ids, total, recut); those that were moved or cut here say
    so. Returns the windows."""
    out, i, j = [], 0, len(windows) - 1
    while i < j:
        to, donor = windows[i], windows[j]
        doc, start, ids, total, _ = donor[2].pop()
        take = min(len(ids), window - to[1])
        if take < len(ids):
            donor[2].append((doc, start, ids[: len(ids) - take], total, True))
        to[2].append((doc, start + len(ids) - take, ids[len(ids) - take :], total, True))
        to[1] += take
        donor[1] -= take
        if to[1] == window:
            out.append(to)
            i += 1
        if not donor[2]:
            j -= 1
    for w in windows[i : j + 1]:
        if w[1] & (w[1] - 1) == 0:
            out.append(w)
            continue
        items, left = w[2][::-1], w[1]
        while left:
            size = need = 1 << (left.bit_length() - 1)
            piece = new_window()
            while need:
                doc, start, ids, total, _ = items.pop()
                piece[2].append((doc, start, ids[:need], total, True))
                if len(ids) > need:
                    items.append((doc, start + need, ids[need:], total, True))
                need -= min(need, len(ids))
            piece[1] = size
            out.append(piece)
            left -= size
    return out


def _pieces(batches, path: str, window: int, end_id: int, most_open: int):
    """A partition's pieces. Whole windows of a long document leave at once; the remainder is placed by
    sum of squares, and the windows that are open at the end are filled from each other (``finish``)."""
    from pyspark import TaskContext

    coder, rule = encoder(path), SumOfSquares(window, most_open)
    serial, end = [TaskContext.get().partitionId() << 36], np.array([end_id], dtype="<u4")
    rows: list[tuple] = []

    def new_window() -> list:
        serial[0] += 1
        return [serial[0] - 1, 0, []]

    def close(w: list) -> None:
        at = 0
        for doc, start, ids, total, recut in w[2]:
            rows.append((doc, start, len(ids), total, w[0], at, recut, ids.tobytes()))
            at += len(ids)

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
        rows.clear()
        return batch

    for batch in small_batches(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.concatenate((coder.encode(text or ""), end))
            total, at = len(ids), 0
            while total - at >= window:
                w = new_window()
                w[2].append((doc, at, ids[at : at + window], total, False))
                close(w)
                at += window
            rest = ids[at:].copy()
            for w in rule.place_cut(rest, lambda a, b: (doc, at + a, rest[a:b], total, False), new_window):
                close(w)
        if rows:
            yield out()
    for w in finish(rule.drain(), window, new_window):
        close(w)
    if rows:
        yield out()


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, most_open: int = 32) -> DataFrame:
    """Packs every document into sequences of at most ``window`` tokens (a power of two).

    Returns one row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, recut (whether the piece
    was moved at the end of its partition, and not placed by the rule) and ids (little-endian unsigned 32-bit).
    Nothing is padded: every sequence is full or a power of two long. Partitions are packed independently,
    straight from the scan and without a shuffle; a partition's memory is ``most_open`` windows and a batch.
    Sequence numbers come from the partition and a serial, so a task that runs again gives the same rows.

    Null or empty text: one piece of the end id. Null ids stay null. Very long texts are packed whole, their
    full windows first. Of equal choices the fullest level is taken. Repeated rows are packed as often as
    they come. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    if window & (window - 1) or window < 2:
        raise ValueError("window must be a power of two")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pieces(it, path, window, end_id, most_open), SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """The digest of the packing of ``docs``, as the query returns it."""
    out = pack(docs, tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "recut")
