"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is
compressed with each in blocks of ``BLOCK`` bytes (so that a long text cannot become its own
dictionary); what the good dictionary saves over the bad one, per byte, together with how far
the better of the two compresses at all, goes through a logistic calibration.

Rows whose crc32(doc_id as text) mod 3 is 1 are held out. Of the others, remainder 0 gives the
dictionaries and remainder 2 the calibration. Both samples are bounded: ``MODEL_DOCS`` labelled
documents of each class, in the order of a hash of their ids, of each at most
``MODEL_CHARS`` characters, and of those ``MODEL_BYTES`` bytes for a dictionary, whose own size is fixed. All documents are scored whole.

Edge cases: empty and null texts get the score at zero difference and no compression; without
labelled texts of both classes every score is 0.5; ids with contradicting labels are not
learnt from; repeated rows get equal results; null ids are not held out; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.words import slices, texts_of

MODEL_DOCS, MODEL_CHARS, MODEL_BYTES, PIECE = 1000, 20_000, 8000, 2000
DICTIONARY_BYTES, LEVEL, BLOCK = 112_640, 3, 1200
FOLDS, HELD_OUT, DICTIONARY_FOLD, CALIBRATION_FOLD = 3, 1, 0, 2


def fold(ids: Column) -> Column:
    return F.crc32(ids.cast("string").cast("binary")) % FOLDS


@dataclass
class Model:
    """The two dictionaries (bad, good) and the calibration; no dictionaries: no model."""

    dictionaries: tuple[bytes, bytes] | None
    calibration: tuple[float, ...] = ()

    def features(self, texts: list[bytes]) -> np.ndarray:
        packers = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            for d in self.dictionaries
        ]
        out = np.zeros((len(texts), 3))
        out[:, 0] = 1.0
        for i, text in enumerate(texts):
            if not text:
                out[i, 2] = 1.0
                continue
            blocks = [text[a : a + BLOCK] for a in range(0, len(text), BLOCK)]
            bad, good = (sum(len(p.compress(b)) for b in blocks) for p in packers)
            out[i, 1:] = (bad - good) / len(text), min(bad, good) / len(text)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.dictionaries is None:
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.calibration), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary from texts; their bytes themselves where they are too few to train one."""
    pieces = [t[a : a + PIECE] for t in texts for a in range(0, min(len(t), MODEL_BYTES), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY_BYTES]


def train(documents: DataFrame, labels: DataFrame, docs: int = MODEL_DOCS) -> Model:
    """A model from documents (doc_id, text) and their labels (doc_id, quality)."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    one = one.where("quality = other").select("doc_id", "quality", fold(F.col("doc_id")).alias("fold")).where(F.col("fold") != HELD_OUT)
    picked = None
    for f in (DICTIONARY_FOLD, CALIBRATION_FOLD):
        for q in (0, 1):
            part = one.where((F.col("fold") == f) & (F.col("quality") == q)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs)
            picked = part if picked is None else picked.unionByName(part)
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text is not null")
    rows = rows.groupBy("doc_id", "quality", "fold").agg(F.min(F.substring("text", 1, MODEL_CHARS)).alias("text"))
    rows = sorted(rows.collect(), key=lambda r: r.doc_id)
    by = {q: [r.text.encode() for r in rows if r.fold == DICTIONARY_FOLD and r.quality == q] for q in (0, 1)}
    tune = [r for r in rows if r.fold == CALIBRATION_FOLD]
    if not (by[0] and by[1] and {r.quality for r in tune} == {0, 1}):
        return Model(None)
    model = Model((dictionary(by[0]), dictionary(by[1])))
    x, y = model.features([r.text.encode() for r in tune]), np.array([r.quality for r in tune], float)
    return Model(model.dictionaries, tuple(logistic(x, y)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents (doc_id, text)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = shared.value.scores(texts_of(part, "text"))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
