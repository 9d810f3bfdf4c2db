"""Text quality from compression with dictionaries of good and bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsieve.llm.common import ship, stored

ship(__name__)

#: Labelled rows of each class that may be used, by smallest hash of the id; the only bound of the model.
SAMPLE_ROWS = 1500
#: Bytes of each dictionary and of the pieces that texts are compressed in: a dictionary helps only near
#: the start of a frame, so a text is compressed in pieces and all pieces count.
DICT_BYTES, PIECE_BYTES, LEVEL = 112_640, 2048, 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray

    def coders(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data in (self.good, self.bad):
            book = zstandard.ZstdCompressionDict(data)
            book.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=book, level=LEVEL, write_content_size=False, write_dict_id=False))
        return out


def _pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)] or [b""]


def features(text: str | None, coders: list) -> list[float]:
    """1, normalised difference of the compressed sizes (bad minus good over their sum), and the mean
    compressed share."""
    data = (text or "").encode("utf-8", "surrogatepass")
    good, bad = (sum(len(c.compress(p)) for p in _pieces(data)) for c in coders)
    return [1.0, (bad - good) / (bad + good), (bad + good) / (2.0 * (len(data) + 16))]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method; the targets are drawn in a little, as for Platt's scaling."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (target - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; text as it is where the trainer finds too little."""
    samples = [p for t in texts for p in _pieces(t.encode("utf-8", "surrogatepass")) if len(p) >= 8]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or b"\n" * 8


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled documents: ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad, others ignored).

    At most ``sample_rows`` rows a class, chosen by hash. Half of each class trains the dictionaries; the
    other half, which they have not seen, calibrates the score, so the score is a probability under the
    class shares of the labels.
    """
    chosen = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality").distinct()
    counts = {r["quality"]: r["n"] for r in chosen.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    parts = [
        chosen.filter(F.col("quality") == c).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample_rows) for c in (0, 1)
    ]
    picked = stored(parts[0].unionAll(parts[1]), "sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id")
    texts = {c: [r["text"] or "" for r in rows.filter(F.col("quality") == c).select("text").toLocalIterator()] for c in (0, 1)}
    half = {c: texts[c][: (len(texts[c]) + 1) // 2] for c in (0, 1)}
    model = Model(_dictionary(half[1]), _dictionary(half[0]), np.zeros(3))
    rest = [(t, c) for c in (0, 1) for t in texts[c][(len(texts[c]) + 1) // 2 :]]
    if not rest:
        return model
    coders = model.coders()
    x, y = np.array([features(t, coders) for t, _ in rest]), np.array([c for _, c in rest], float)
    model.weights = _calibrate(x, y)
    # The sample holds the classes in other shares than the labels.
    if y.min() != y.max() and counts.get(0) and counts.get(1):
        model.weights[0] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (1 - y).sum())
    return model


def _score(model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = model.value.coders()
        for batch in batches:
            x = np.array([features(v.as_py(), coders) for v in batch.column(1)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(x @ model.value.weights))], schema=schema)

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, score`` per row of ``docs``: the calibrated probability that a text is of good quality.

    The score sees the whole text and nothing else. Null and empty texts are compressed as the empty text
    and get its score; without labels of both classes the score is what the labels at hand give (0.5
    without any). Rows are independent: repeats and null ids pass through, extra columns are ignored; no
    shuffle. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_rows))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_score(model), "doc_id bigint, score double")
