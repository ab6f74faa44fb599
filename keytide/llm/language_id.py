"""Language identification: nearest centroid by cosine over normalised TF-IDF trigram vectors.

Fit: a bounded sample (`per_label` texts of each language, `max_rows` in all, so fewer of each where languages are
very many; none is left out) gives the inverse document frequencies and, per language, `clusters` centroids by spherical
k-means. Only sparse vectors of at most `2^bits` entries of 4 bytes reach the driver. Prediction: one pass over whole texts; the
label of the centroid with the largest cosine. A text farther from it than the centroid's radius
(a quantile of its members' distances, and a margin for rounding) is marked `rejected`.

Defined cases: null texts and texts without a letter give `und`, score 0, rejected. Null labels
and null ids are never learned from. Without anything to learn every text is `und`. Repeated rows
are answered row by row; ties between centroids go to the label that sorts first; other columns aren't read; very long
texts are counted in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.sampling import bounded
from keytide.llm.text import CHUNK, padded_chunks
from keytide.session import ship

BITS = 13
ROWS = 384
#: Single precision rounds a cosine by less than this: the text that sets a radius lies inside it however it is computed.
MARGIN = 1e-5
UNKNOWN = "und"
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray
    bits: int = BITS


def term_counts(col: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, counts) with a row of hashed trigram counts for each text."""
    for row, end, data, offsets in padded_chunks(col, " ", "  "):
        if end - row == 1:  # maybe a very long text
            total = np.zeros(1 << bits, np.int64)
            for a in range(0, len(data) - 2, CHUNK):
                code, use = _codes(data[a : a + CHUNK + 2], bits)
                total += np.bincount(code[use], minlength=1 << bits)
            yield row, end, total.astype(np.float32)[None, :]
            continue
        code, use = _codes(data, bits)
        for a in range(0, end - row, ROWS):
            b = min(a + ROWS, end - row)
            lo, hi = offsets[a], max(offsets[a], offsets[b] - 2)
            sizes = np.diff(offsets[a : b + 1])
            at = np.repeat(np.arange(b - a, dtype=np.int64) << bits, sizes)[: hi - lo]
            keep = use[lo:hi]
            n = np.bincount(at[keep] + code[lo:hi][keep], minlength=(b - a) << bits)
            yield row + a, row + b, n.reshape(b - a, -1).astype(np.float32)


def _codes(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigram at each byte but the last two, and whether its middle is a letter."""
    kind = _CLASS[data].astype(np.uint32)
    code = (kind[:-2] << np.uint32(16)) | (kind[1:-1] << np.uint32(8)) | kind[2:]
    code *= np.uint32(0x9E3779B1)
    code >>= np.uint32(32 - bits)
    return code, kind[1:-1] != 32


def _clustered(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from a farthest-first start; unit centroids and each row's cluster."""
    picks = [0]
    nearest = x @ x[0]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[picks[-1]])
    c = x[picks].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c, np.argmax(x @ c.T, axis=1)


def fit(df: DataFrame, id_col: str, text: str, label: str, *, per_label: int = 1000, max_rows: int = 8000, clusters: int = 4, quantile: float = 0.995, bits: int = BITS) -> Model:
    """Learns from the rows of `df` with a label; the caller chooses which rows those are."""
    ship(df.sparkSession)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, n in term_counts(batch.column(2), bits):
                index = [np.flatnonzero(x) for x in n]
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([i.astype(np.uint16).tobytes() for i in index], pa.binary()), pa.array([np.minimum(x[i], 65_535).astype(np.uint16).tobytes() for x, i in zip(n, index)], pa.binary())], ["label", "draw", "at", "n"])

    rows, per_label = bounded(df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(label).alias("label")).where(F.col("text").rlike("\\p{L}")), "label", "id", per_label, max_rows)
    found = rows.select("label", "_draw", "text").mapInArrow(sparse, "label string, draw bigint, at binary, n binary").collect()
    by: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r.label, r.draw, bytes(r.at))):
        if len(own := by.setdefault(r.label, [])) < per_label:
            own.append(r)
    labels, size = sorted(by), 1 << bits
    df_ = np.zeros(size)
    total = sum(map(len, by.values()))
    for own in by.values():
        for r in own:
            df_[np.frombuffer(r.at, np.uint16)] += 1
    idf = (np.log((1 + total) / (1 + df_)) + 1).astype(np.float32)
    centroids, owner, radius = [np.zeros((0, size), np.float32)], [], []
    for j, name in enumerate(labels):
        x = np.zeros((len(by[name]), size), np.float32)
        for i, r in enumerate(by[name]):
            at = np.frombuffer(r.at, np.uint16)
            x[i, at] = np.log1p(np.frombuffer(r.n, np.uint16).astype(np.float32)) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c, own = _clustered(x, clusters)
        far = 1 - np.einsum("ij,ij->i", x, c[own])
        centroids.append(c)
        owner += [j] * len(c)
        radius += [float(np.quantile(far[own == k], quantile)) + MARGIN if (own == k).any() else 0.0 for k in range(len(c))]
    return Model(labels, idf, np.concatenate(centroids), np.array(owner, np.int64), np.array(radius), bits)


def predict(df: DataFrame, id_col: str, text: str, model: Model) -> DataFrame:
    """(id, lang_pred, score, rejected) of every row: nearest centroid's label, its cosine, and whether the text lies outside its radius."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.labels, UNKNOWN], object)
        for batch in batches:
            best, score, far = np.full(len(batch), len(m.labels)), np.zeros(len(batch)), np.ones(len(batch), bool)
            letters = np.asarray(batch.column(2).fill_null(False))
            if m.labels:
                for row, end, x in term_counts(batch.column(1), m.bits):
                    np.log1p(x, out=x)
                    x *= m.idf
                    cos = (x @ m.centroids.T) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    top = np.argmax(cos, axis=1)
                    best[row:end], score[row:end] = m.owner[top], np.clip(cos[np.arange(len(top)), top], 0, 1)
                    far[row:end] = 1 - score[row:end] > m.radius[top]
                best[~letters], score[~letters], far[~letters] = len(m.labels), 0, True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(far)], ["id", "lang_pred", "score", "rejected"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(text).rlike("\\p{L}").alias("letters"))
    return rows.mapInArrow(labelled, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
