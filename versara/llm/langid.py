"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, small_batches, table

UNDETERMINED = "und"
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))


@dataclass(frozen=True)
class Settings:
    """``slots``: training documents per language at most (the bound of the sample that leaves the
    executors). ``bits``: hash buckets as a power of two. ``longest``: letters of the longest subword.
    ``steps``: steps of the descent, however many documents there are. ``reject_share``: the share of documents like the calibration ones that either floor is to reject.
    ``prior``: how many usual subwords are added to a text when its likeness is judged, as a few subwords say
    little."""

    slots: int = 400
    bits: int = 15
    longest: int = 4
    width: int = 16
    steps: int = 300
    batch: int = 64
    rate: float = 40.0
    decay: float = 1e-6
    seed: int = 7
    reject_share: float = 0.001
    prior: float = 100.0


@dataclass
class Model:
    """``scores`` holds the logits that each bucket adds (embedding times output matrix): a document's
    logits are the mean over its subwords plus ``bias``. ``usual`` holds the log frequency of each bucket in
    all languages, each of the same weight, ``centre`` the median of the documents' means: a text's likeness
    is by how much the mean of its subwords is above the centre, so texts in several languages are alike. ``floor``, ``unlike``: the confidence and the likeness
    below which a document is rejected."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    floor: float = 0.0
    usual: np.ndarray | None = None
    centre: float = 0.0
    unlike: float = -np.inf
    settings: Settings = field(default_factory=Settings)


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def subwords(text: str, s: Settings) -> np.ndarray:
    """The buckets of every subword of 1 to ``longest`` letters of a whole text, lower-cased; a word's
    edge counts as a letter at either end of a subword. No letters: empty."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points = np.where(_letters()[points], points, np.uint32(0))
    if not points.any():
        return np.empty(0, dtype=np.uint32)
    kept = points[(points != 0) | (np.concatenate((np.ones(1, np.uint32), points[:-1])) != 0)]
    c = np.concatenate((np.zeros(1, np.uint32), kept, np.zeros(1, np.uint32)))
    edge = c == 0
    shift, out = np.uint32(32 - s.bits), []
    h, inner = c * _MIX[0], np.zeros(len(c), dtype=bool)
    for n in range(1, s.longest + 1):
        if n > 1:
            if len(c) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[1] + c[n - 1 :] * _MIX[0] + np.uint32(n)
            inner = (inner[:-1] | edge[n - 2 : -1]) if n > 2 else np.zeros(len(c) - 1, dtype=bool)
        ok = ~edge if n == 1 else ~inner & ~(edge[: len(h)] & edge[n - 1 :])
        out.append((h[ok] * _MIX[0]) >> shift)
    return np.concatenate(out)


def _vectors(batches, s: Settings):
    """(lang, slot, buckets, counts) of the training documents."""
    for batch in small_batches(batches):
        rows = []
        for lang, slot, text in zip(*(c.to_pylist() for c in batch.columns)):
            ids, counts = np.unique(subwords(text, s), return_counts=True)
            rows.append((lang, slot, ids.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["lang", "slot", "ids", "counts"])


def sample(docs: DataFrame, usable: Column, s: Settings) -> list:
    """At most ``slots`` labelled documents of each language, the same ones on every run: the ids fall
    into slots by hash, and of each language's slot the id of least hash is taken. Only ids and languages
    are read for that; the texts of the chosen are read in a second scan."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(s.slots)).cast("int")
    first = known.groupBy("lang", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(s.seed)).alias("h"), "doc_id")).alias("m"))
    chosen = first.select("lang", "slot", F.col("m.doc_id").alias("doc_id"))
    picked = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    rows = picked.select("lang", "slot", "text").mapInArrow(lambda it: _vectors(it, s), "lang string, slot int, ids binary, counts binary").collect()
    return sorted((r for r in rows if r.ids), key=lambda r: (r.lang, r.slot, bytes(r.ids)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(x: np.ndarray, y: np.ndarray, emb: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The mean cross-entropy of documents (rows of ``x`` are their subwords' shares, of ``y`` their languages),
    and its gradients by embeddings, output matrix and bias."""
    hidden = x @ emb
    p = _softmax(hidden @ out + bias)
    g = (p - y) / len(x)
    return float(-(y * np.log(np.maximum(p, 1e-12))).sum() / len(x)), x.T @ (g @ out.T), hidden.T @ g, g.sum(axis=0)


def descend(x: np.ndarray, y: np.ndarray, emb: np.ndarray, out: np.ndarray, bias: np.ndarray, rate: float, decay: float) -> None:
    """One step, in place. Embeddings take the full rate, as a bucket's share of a document is small; the output
    matrix at most 1, the bias a tenth of that."""
    _, by_emb, by_out, by_bias = gradients(x, y, emb, out, bias)
    out -= min(rate, 1.0) * (by_out + decay * out)
    emb -= rate * (by_emb + decay * emb)
    bias -= 0.1 * min(rate, 1.0) * by_bias


def tail(x: np.ndarray, share: float) -> float:
    """The value below which about ``share`` of documents like these lie: their quantile, or, as few documents
    don't reach so far, the end of an exponential tail through their lowest tenth if that is lower, made longer
    by twice the error of its mean."""
    start = np.quantile(x, 0.1)
    below = x[x <= start]
    mean = float((start - below).mean()) * (1 + 2 / len(below) ** 0.5)
    return float(min(np.quantile(x, share), start - mean * np.log(0.1 / share)))


def fit(rows: list, s: Settings) -> Model:
    """Stochastic gradient descent on four fifths of the sample; the last fifth sets the temperature (by
    likelihood) and both floors (``tail``): that of the confidence and that of the likeness, by
    which texts go that are unlike all training languages, however sure the softmax is of them."""
    languages, size = sorted({r.lang for r in rows}), 1 << s.bits
    if not languages:
        return Model([], np.zeros((size, 0), np.float32), np.zeros(0, np.float32), settings=s)
    rng = np.random.default_rng(s.seed)
    emb = rng.normal(0, 0.1, (size, s.width)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (s.width, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    at = {x: i for i, x in enumerate(languages)}

    def dense(some: list) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros((len(some), size), np.float32), np.zeros((len(some), len(languages)), np.float32)
        for i, r in enumerate(some):
            counts = np.frombuffer(r.counts, "<u4")
            x[i, np.frombuffer(r.ids, "<u4")] = counts / counts.sum()
            y[i, at[r.lang]] = 1
        return x, y

    held = [r for r in rows if r.slot % 5 == 4]
    train = [r for r in rows if r.slot % 5 != 4] or rows
    order: list[int] = []
    for step in range(s.steps):
        while len(order) < s.batch:
            order += rng.permutation(len(train)).tolist()
        some, order = order[: s.batch], order[s.batch :]
        x, y = dense([train[j] for j in some])
        descend(x, y, emb, out, bias, s.rate * (1 - step / s.steps), s.decay)
    seen = np.full((size, len(languages)), 0.5)
    for r in train:
        seen[np.frombuffer(r.ids, "<u4"), at[r.lang]] += np.frombuffer(r.counts, "<u4")
    usual = np.log((seen / seen.sum(axis=0)).mean(axis=1)).astype(np.float32)
    model = Model(languages, emb @ out, bias, usual=usual, settings=s)
    held = held or train
    z, y, like, n = [], [], [], []
    for i in range(0, len(held), s.batch):
        x, t = dense(held[i : i + s.batch])
        z.append(x @ model.scores + bias)
        like.append(x @ usual)
        y.append(t.argmax(axis=1))
        n += [np.frombuffer(r.counts, "<u4").sum() for r in held[i : i + s.batch]]
    z, y, like, n = np.concatenate(z), np.concatenate(y), np.concatenate(like), np.array(n, float)
    # a few documents that are all right don't prove certainty: the targets are smoothed by Laplace's rule
    doubt = 1 / (len(y) + 2)
    target = (1 - doubt) * np.eye(len(languages))[y] + doubt / len(languages)
    loss = lambda t: -(target * np.log(np.maximum(_softmax(z / t), 1e-300))).sum(axis=1).mean()
    model.temperature = float(min(np.geomspace(0.01, 100, 161), key=loss))
    model.floor = min(0.5, tail(_softmax(z / model.temperature).max(axis=1), s.reject_share))
    model.centre = float(np.median(like))
    model.unlike = tail((like - model.centre) * n / (n + s.prior), s.reject_share)
    return model


def train(docs: DataFrame, usable: Column | None = None, settings: Settings | None = None) -> Model:
    """Fits a model on the rows of ``docs(doc_id, text, lang)`` where ``usable`` holds: on ``slots`` of each
    language at most. Rows with a null id, text or language, and texts without letters, aren't learnt from; a
    repeated row that is chosen is learnt from as often as it comes. Very long texts count as one document like
    any other, whole. Of equal hashes the smaller id is taken. An empty table gives a model without languages."""
    ship(docs.sparkSession)
    s = settings or Settings()
    return fit(sample(docs.select("doc_id", "text", "lang"), F.lit(True) if usable is None else usable, s), s)


_SPACE = re.compile(r"\s")


def blocks(text: str, size: int = 1 << 18) -> Iterator[str]:
    """A text in blocks of about ``size`` characters that end at white space, so no word is cut."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + size)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def classify(text: str | None, m: Model) -> tuple[str, float, bool]:
    """(language, confidence, rejected) of a whole text, in blocks, so that memory stays bounded."""
    total, like, n = np.zeros(len(m.languages)), 0.0, 0
    for block in blocks(text or ""):
        ids = subwords(block, m.settings)
        if len(ids):
            total += m.scores.take(ids, axis=0).sum(axis=0, dtype=np.float64)
            like += float(m.usual.take(ids).sum(dtype=np.float64)) if m.usual is not None else 0
            n += len(ids)
    if not n or not m.languages:
        return UNDETERMINED, 0.0, True
    p = _softmax(((total / n + m.bias) / m.temperature)[None])[0]
    best = int(p.argmax())
    unlike = m.usual is not None and (like / n - m.centre) * n / (n + m.settings.prior) < m.unlike
    return m.languages[best], float(p[best]), bool(p[best] < m.floor or unlike)


def _predictions(batches, m: Model):
    for batch in small_batches(batches):
        got = [classify(t, m) for t in batch.column(1).to_pylist()]
        lang, score, rejected = zip(*got) if got else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])


def predict(docs: DataFrame, m: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every row, from its whole text alone.

    Null texts and texts without a letter: ``und`` with score 0, rejected. A model without languages
    calls everything ``und``. Of languages with the same score the first in alphabetical order is taken. Very
    long texts are read whole, in blocks that end at white space. Repeated rows come back as often; null ids
    stay null; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predictions(it, m), "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    """The documents that no model may learn from (null ids: not held out, and not learnt from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def _accepted(batches, m: Model, names: list[str]):
    """The rows whose text is not rejected, as they are."""
    at = names.index("text")
    for batch in small_batches(batches):
        keep = pa.array([not classify(t, m)[2] for t in batch.column(at).to_pylist()], pa.bool_())
        yield batch.filter(keep)


def accepted(docs: DataFrame, m: Model) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns unchanged."""
    ship(docs.sparkSession)
    names = docs.columns
    return docs.mapInArrow(lambda it: _accepted(it, m, names), docs.schema)
