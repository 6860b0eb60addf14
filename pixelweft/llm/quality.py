"""Quality by compression: which dictionary, of good or of bad text, makes a text smaller.

Two zstandard dictionaries are built from the labelled texts of a bounded sample.
A text is compressed in pieces with each; the difference of the two sizes by their
sum is the normalised difference, and a logistic curve fitted on labelled texts
that went into neither dictionary turns it into a score. The curve also sees the
better size by the text's own (texts that repeat themselves) and the length. Pieces
keep the dictionary in force over the whole of a long text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fit_logistic, fold, logistic, sample

#: Labelled rows of either label that a model is fitted on, at most.
SAMPLE = 1000
#: Bytes of a piece, of a dictionary's text, and the zstandard level.
PIECE, DICTIONARY, LEVEL = 2048, 40_000, 3
REJECT_BELOW = 0.3


def _pieces(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[a : a + PIECE] for a in range(0, len(data), PIECE)]


class CompressionClassifier:
    def __init__(self, good: bytes, bad: bytes, curve: np.ndarray | None = None) -> None:
        self.good, self.bad, self.curve = good, bad, curve

    @functools.cached_property
    def _coders(self) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
        options = dict(level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        out = []
        for data in (self.good, self.bad):
            d = zstd.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            out.append(zstd.ZstdCompressor(dict_data=d, **options))
        return tuple(out)

    def __getstate__(self) -> dict:
        return {"good": self.good, "bad": self.bad, "curve": self.curve}

    def measures(self, text: str | None) -> tuple[float, float, float]:
        """(bad - good) / (bad + good) of the compressed sizes, above zero if the good dictionary serves better; the better size by the text's; log length. Zeros for no text."""
        good, bad = self._coders
        g = b = n = 0
        for piece in _pieces(text or ""):
            g += len(good.compress(piece))
            b += len(bad.compress(piece))
            n += len(piece)
        return ((b - g) / (b + g), min(b, g) / n, float(np.log1p(n))) if n else (0.0, 0.0, 0.0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return logistic(np.array([self.measures(t) for t in texts]).reshape(-1, 3), self.curve)


def dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary trained on all pieces of the texts; their own bytes where they are too few to train on."""
    parts = [p for t in texts for p in _pieces(t)]
    try:
        return zstd.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstd.ZstdError:
        return b"".join(parts)[-DICTIONARY:] or b"no text"


def fit(rows: pd.DataFrame) -> CompressionClassifier:
    """A classifier of rows (doc_id, text, y, weight): half of them make the dictionaries, the other half the curve."""
    half = np.arange(len(rows)) % 2 == 0
    texts = lambda keep, y: rows.text[keep & (rows.y == y)].tolist()
    model = CompressionClassifier(dictionary(texts(half, 1)), dictionary(texts(half, 0)))
    rest = rows[~half]
    if len(rest) and rest.y.nunique() == 2:
        x = np.array([model.measures(t) for t in rest.text])
        model.curve = fit_logistic(x, rest.y.to_numpy(float), rest.weight.to_numpy(float), l2=1e-6)
    else:  # one label or none: its share, whatever the text
        p = np.clip(rows.y.mean() if len(rows) else 0.5, 0.01, 0.99)
        model.curve = np.array([0.0, 0.0, 0.0, np.log(p / (1 - p))])
    return model


def scored(docs: DataFrame, model: CompressionClassifier, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Null and empty texts have measures of zero and the score of those. A null
    doc_id is not held out. Repeated rows get a row each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.score(part.column(2).to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= REJECT_BELOW).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", each: int = SAMPLE) -> DataFrame:
    """scored() by a classifier fitted on at most each labelled documents of either label outside the held-out fold."""
    return scored(docs, fit(sample(docs, labels, label, each, text)), text)


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", each: int = SAMPLE, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of docs, with all their columns, whose score is reject_below or more."""
    model, at, schema = fit(sample(docs, labels, label, each, text)), docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield part.filter(pa.array(model.score(part.column(at).to_pylist()) >= reject_below))

    return docs.mapInArrow(run, schema)
