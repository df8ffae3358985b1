"""Toxicity by compression distance: how much shorter windows of a text get with a zstandard dictionary of toxic text.

Two dictionaries are trained on labelled rows: one on windows of ordinary texts, one on the passages of toxic texts whose
6-byte strings stand in a far larger share of toxic texts than of ordinary ones. A window is compressed with the ordinary
dictionary, and with it and the toxic one; the differences over all windows of a text, calibrated by logistic regression, give
the score. Labels, language, source and id are never inputs of a score.

The fit takes a bounded sample of labelled rows in the order of a hash of their ids: at most MOST_TOXIC and MOST_ORDINARY.
A null or empty text has one empty window. Without both kinds of labels every score is the share of toxic labels (no labels:
0). Rows of labels with nulls are left out; of several texts with a labelled id the least is learnt from. Repeated rows are
scored each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TOXIC, MOST_ORDINARY = 1_500, 3_000
WINDOW, STRIDE, LEVEL = 64, 32, 3
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 4_096
GRAM = 6
#: A toxic 6-byte string stands in so many toxic texts at least, in this share of them, and so many times oftener.
LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO = 4, 0.02, 8.0
THRESHOLD = 0.3


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def windows(data: bytes) -> list[bytes]:
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - STRIDE), STRIDE)]


def _grams(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < GRAM:
        return np.zeros(0, np.uint64)
    out = np.zeros((len(raw) - GRAM + 1, 8), np.uint8)
    out[:, :GRAM] = np.lib.stride_tricks.sliding_window_view(raw, GRAM)
    return out.view("<u8").ravel()


def _texts_with(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(_grams(t)) for t in texts]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)


def toxic_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    grams, n = _texts_with(toxic)
    others, m = _texts_with(ordinary)
    at = np.minimum(np.searchsorted(others, grams), max(len(others) - 1, 0))
    rest = np.where(others[at] == grams, m[at], 0) if len(others) else np.zeros(len(grams), int)
    ratio = ((n + 0.5) / (len(toxic) + 1)) / ((rest + 0.5) / (len(ordinary) + 1))
    marks = grams[(n >= max(LEAST_TEXTS, LEAST_SHARE * len(toxic))) & (ratio > LEAST_RATIO)]
    out = []
    for t in toxic:
        hit = np.isin(_grams(t), marks)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        out += [t[a : b + GRAM - 1] for a, b in edge.reshape(-1, 2)]
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; of samples too few or too small to train one, the samples themselves."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, total // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        if total > 8 * ORDINARY_BYTES:
            raise
        return b"".join(dict.fromkeys(samples))


class Model:
    """Two dictionaries and the weights of a window's differences."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = ordinary, toxic
        self.mean, self.spread, self.weights = np.zeros(6), np.ones(6), np.zeros(7)

    def compressors(self):
        def of(raw: bytes):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        return of(self.ordinary), of(self.ordinary + self.toxic)

    @staticmethod
    def features(data: bytes, compressors) -> list[float]:
        a, b = compressors
        d = np.array([len(a(w)) - len(b(w)) for w in windows(data)])
        top = -np.sort(-d)[:3]
        return [top[0], top.mean(), d.mean(), (d >= 2).mean(), np.log1p((d >= 3).sum()), (d >= 4).mean()]

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> None:
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = np.c_[np.ones(len(x)), (x - self.mean) / self.spread]
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ self.weights, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(a.shape[1]) * ridge
            self.weights = self.weights + np.linalg.solve(h, a.T @ (y - p) - ridge * self.weights)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((x - self.mean) / self.spread * self.weights[1:]).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    pick = lambda c, n: known.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick("toxic = 1", MOST_TOXIC).unionByName(pick("toxic <> 1", MOST_ORDINARY))
    # at most MOST_TOXIC + MOST_ORDINARY ids
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = own.select("text", "toxic", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").collect()
    texts = [normal(r[0]) for r in rows]
    y = np.array([float(r[1] == 1) for r in rows])
    toxic, ordinary = ([t for t, v in zip(texts, y, strict=True) if v == kind] for kind in (1, 0))
    usual = [w for t in ordinary for w in windows(t)]
    model = Model(trained(usual, ORDINARY_BYTES), trained(toxic_passages(toxic, ordinary), TOXIC_BYTES))
    if toxic and ordinary:
        both = model.compressors()
        model.fit(np.array([model.features(t, both) for t in texts]), y)
    else:
        model.weights[0] = 30.0 if toxic else -30.0
    return model


def score(docs: DataFrame, model: Model, cols: tuple[str, ...] = ("doc_id",), name: str = "_score") -> DataFrame:
    """cols of docs, and the score of each whole text under a name that cols don't have."""

    def run(batches):
        both = model.compressors()
        for b in batches:
            x = np.array([model.features(normal(t), both) for t in b.column("text").to_pylist()]).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(model.scores(x), pa.float64())], [*cols, name])

    take = docs.select(*dict.fromkeys([*cols, "text"]))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return take.mapInArrow(run, f"{fields}, `{name}` double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, train(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below the threshold."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels), tuple(docs.columns), name).where(F.col(name) < THRESHOLD).select(*docs.columns)
