"""Language identification by string kernels (operator 4).

The kernel of two texts is the number of byte n-grams, of one to four bytes in lower case,
that both have (a blended spectrum of presences), over the root of what each shares with
itself.  N-grams of each length are hashed into ``WIDTH`` places.  ``LANDMARKS`` texts for a
language give Nystroem features, and kernel ridge regression of each language against the
rest is fitted on at most ``SAMPLE`` labelled documents, those of the least hash of their
id.  Scoring is two matrix products for a batch: presences with landmarks, and the kernels
with the regression's weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.textkit import LOWER, U64, batch, bounded, chunks, ids_and_text, remainder

LONGEST, WIDTH = 4, 1 << 13
LANDMARKS, SAMPLE = 24, 3000
RIDGE, SHARPNESS = 1e-3, 8.0
#: Documents and bytes of one matrix product.
ROWS, BYTES = 192, 1 << 19


def presences(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of 0 and 1 for each document: the places of its n-grams."""
    n = len(off) - 1
    out = np.zeros((n, LONGEST * WIDTH), bool)
    flat = out.reshape(-1)
    low = LOWER[data].astype(np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int64) * (LONGEST * WIDTH), np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(data))  # bytes to the document's end
    code = np.zeros(len(data), np.uint32)
    for k in range(LONGEST):
        code = code[: len(data) - k] << np.uint32(8) | low[k:] if k else low.copy()
        place = (code.astype(U64) * U64(0x9E3779B97F4A7C15) >> U64(64 - 13)).astype(np.int64) + k * WIDTH
        inside = left[: len(code)] > k
        flat[(owner[: len(code)] + place)[inside]] = True
    return out


def _blocks(column):
    """Chunks of at most ROWS documents."""
    for i, j, data, off in chunks(column, BYTES):
        for a in range(0, j - i, ROWS):
            b = min(j - i, a + ROWS)
            yield i + a, i + b, data[off[a] : off[b]], off[a : b + 1] - off[a]


class Classifier:
    def __init__(self, names: list[str], landmarks: np.ndarray, weights: np.ndarray) -> None:
        self.names = names
        self.packed = np.packbits(landmarks, axis=1)  # what is sent to the executors
        self.weights = weights.astype(np.float32)
        self._ready: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def kernels(self, x: np.ndarray) -> np.ndarray:
        if self._ready is None:
            marks = np.unpackbits(self.packed, axis=1, count=LONGEST * WIDTH).astype(np.float32)
            self._ready = (marks.T.copy(), np.sqrt(np.maximum(marks.sum(1), 1)))
        marks, norm = self._ready
        own = np.sqrt(np.maximum(x.sum(1), 1)).astype(np.float32)
        return (x.astype(np.float32) @ marks) / norm / own[:, None]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, score between 0 and 1) of each row of presences."""
        y = self.kernels(x) @ self.weights
        e = np.exp(SHARPNESS * (y - y.max(1, keepdims=True)))
        p = e / e.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def fit(packed: list[bytes], langs: list[str]) -> Classifier:
    """Landmarks are the first texts of each language in the sample; Nystroem, then ridge."""
    names = sorted(set(langs))
    if not names:
        return Classifier([], np.zeros((0, LONGEST * WIDTH), np.uint8), np.zeros((0, 0)))
    bits = np.stack([np.frombuffer(p, np.uint8) for p in packed])
    which = np.array([names.index(x) for x in langs])
    marks = np.concatenate([np.flatnonzero(which == k)[:LANDMARKS] for k in range(len(names))])
    rows = lambda at: np.unpackbits(bits[at], axis=1, count=LONGEST * WIDTH)
    own = Classifier(names, rows(marks), np.zeros((len(marks), len(names))))
    kernel = np.concatenate([own.kernels(rows(np.arange(a, min(a + ROWS, len(bits))))) for a in range(0, len(bits), ROWS)]).astype(np.float64)
    value, vector = np.linalg.eigh(kernel[marks])
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # K_mm to the power -1/2
    phi = kernel @ root
    target = np.where(which[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    inside = np.linalg.solve(phi.T @ phi + RIDGE * len(phi) * np.eye(phi.shape[1]), phi.T @ target)
    own.weights = (root @ inside).astype(np.float32)
    return own


def train(docs: DataFrame, lang_col: str = "lang", most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit on texts with a language whose crc32(id) mod 5 is not 0, about ``most`` in all and as many of each language.

    Texts that are null or have no letter are left out; of several texts of one id that of the
    least hash counts.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    known = source.where("lang is not null and text rlike '\\\\p{L}' and doc_id is not null").where(remainder("doc_id", 5) != 0)
    # as many of each language, so that a rare one is learned too
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.lit(float(most)) / (F.lit(max(1, counts.count())) * F.col("n"))
    told = counts.select(F.col("lang").alias("its_lang"), share.alias("share"))
    texts = known.join(bounded(told, 128), F.col("lang") == F.col("its_lang")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("share") * F.lit(1 << 40)).select("doc_id", "text", "lang", F.xxhash64("text").alias("h"))
    out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("h", pa.int64()), ("bits", pa.binary())])

    def run(batches):
        for b in batches:
            for i, j, data, off in _blocks(b.column(1)):
                yield batch(out, [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), b.column(3).slice(i, j - i), [p.tobytes() for p in np.packbits(presences(data, off), axis=1)]])

    # repeated rows are one before they reach the driver
    rows = texts.mapInArrow(run, "doc_id long, lang string, h long, bits binary").groupBy("doc_id").agg(F.min_by(F.struct("lang", "bits"), "h").alias("x")).select("doc_id", "x.lang", "x.bits").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    return fit([rows.column("bits")[int(k)].as_py() for k in order], [rows.column("lang")[int(k)].as_py() for k in order])


def identify(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every row of ``docs``, repeated ones included.

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing
    could be learned.  Every text is read whole, whatever its length; of languages with equal
    scores the first by name counts.
    """
    model = docs.sparkSession.sparkContext.broadcast(classifier)
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    names = np.array([*classifier.names, "und"], object)
    source = ids_and_text(docs, id_col, text_col).withColumn("letters", F.coalesce(F.expr("text rlike '\\\\p{L}'"), F.lit(False)))

    def run(batches):
        for b in batches:
            letters = b.column(2).to_numpy(zero_copy_only=False)
            for i, j, data, off in _blocks(b.column(1)):
                best, p = model.value.predict(presences(data, off)) if len(names) > 1 else (np.zeros(j - i, np.int64), np.zeros(j - i))
                best = np.where(letters[i:j], best, len(names) - 1)
                yield batch(out, [b.column(0).slice(i, j - i), names[best].tolist(), np.where(letters[i:j], p, 0.0).astype(np.float64)])

    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")
