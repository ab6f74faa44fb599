"""Toxicity: bags of subword embeddings, averaged, under a linear softmax, trained jointly in numpy.

A word is the average of the embeddings of its character n-grams (3 to 5 bytes with word edges), so
unseen misspellings share vectors with words seen. A window is the average over `WINDOW` words, each
distinct word once (so one repeated word isn't a window), and a text is as toxic as its most toxic
window: long texts don't dilute a short insult. The maximum of more windows is higher by chance; the tail of
the clean training texts' windows, taken as exponential, tells by how much, and scores of texts of more windows than usual in training are lowered by it. Embeddings and
softmax are trained together by full-batch gradient descent with momentum; the first rounds average over the whole text, the
others descend through each text's most toxic window.

With n-gram vectors E and softmax W, the logit difference of a word is linear in v = E (w1 - w0).
Scoring therefore needs only v, a fixed 4 * 2^bits bytes that are broadcast, and one pass over whole texts.

Fit: a bounded sample of `per_class` labelled texts of each class, `max_bytes` of text in all. If a class has more,
its longest texts are cut, by sampling their windows, to the one length at which all fit; none is left out.
Defined cases: null and empty texts, and texts without a word, get score 0: nothing in them is toxic;
null labels and null ids are not learned from; an id labelled more than once is toxic if any label
is; without labels of both classes every other score is the share of toxic labels (0 if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.sampling import bounded
from keytide.llm.text import CHUNK, mix, padded_chunks, release, word_hashes, word_spans
from keytide.session import ship

BITS = 18
WINDOW = 32
#: A shorter window counts as so many words.
LEAST = 8
#: The windows of clean training texts above this quantile are their tail.
TAIL = 0.9
STEPS = (600.0, 0.3, 1.0)
GRAMS = (3, 4, 5)
#: Signs that stand in for letters stay inside words.
_SEP = np.ones(256, bool)
_SEP[48:58] = _SEP[65:91] = _SEP[97:123] = _SEP[128:] = False
_SEP[[ord("@"), ord("$"), ord("*")]] = False


@dataclass
class Model:
    v: np.ndarray
    bias: float
    bits: int = BITS
    #: The maximum over n windows counts less by tail * log(n / usual), if n is more than `usual`.
    tail: float = 0.0
    usual: float = 1.0


def _grams(data: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, the bucket of the n-gram that starts at each byte, and whether it lies in one word with its edges."""
    sep = _SEP[data]
    byte = np.where(sep, 32, data).astype(np.uint32)
    inner = np.concatenate([[0], np.cumsum(sep)])
    for n in GRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        code = np.full(m, 0x811C9DC5 + n, np.uint32)
        for k in range(n):
            code ^= byte[k : k + m]
            code *= np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        yield code >> np.uint32(32 - bits), inner[n - 1 : n - 1 + m] == inner[1 : m + 1]


def _word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: np.ndarray, bits: int) -> np.ndarray:
    """The average of v over the n-grams of each word."""
    out = np.empty(len(starts))
    i = 0
    while i < len(starts):
        # a block of words with the separators around them
        low = int(starts[i]) - 1
        j = max(i + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        part = data[low : int(ends[j - 1]) + 1]
        total, number = np.zeros(len(part) + 1, np.float64), np.zeros(len(part) + 1, np.int32)
        value, count = np.zeros(len(part), np.float32), np.zeros(len(part), np.int8)
        for bucket, use in _grams(part, bits):
            value[: len(use)] += np.where(use, v[bucket], np.float32(0))
            count[: len(use)] += use
        np.cumsum(value, dtype=np.float64, out=total[1:])
        np.cumsum(count, dtype=np.int32, out=number[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[b] - total[a - 1]) / np.maximum(number[b] - number[a - 1], 1)
        i = j
    return out


def _windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows by word offsets: the first word of each window, its length, and the window offsets of the rows. Rows without words have none."""
    n = -(-np.diff(offsets) // WINDOW)
    first = np.concatenate([[0], np.cumsum(n)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], n)
    start = np.repeat(offsets[:-1], n) + k * WINDOW
    return start, np.minimum(start + WINDOW, np.repeat(offsets[1:], n)) - start, first


def _segmented(ufunc: np.ufunc, x: np.ndarray, offsets: np.ndarray, empty: float) -> np.ndarray:
    out = np.full(len(offsets) - 1, empty, np.float64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = ufunc.reduceat(x, offsets[:-1][full])
    return out


def _train(texts: list[str], y: np.ndarray, bits: int, dim: int, rounds: int, seed: int) -> Model:
    """The model of the texts, which are emptied as soon as they are read."""
    words: list[np.ndarray] = []
    offsets, spelled = [0], {}
    for row, end, data, at in padded_chunks(pa.array(texts, pa.string()), " ", " "):
        s, e, w = word_spans(data, at, _SEP)
        h = word_hashes(data, s, e)
        words.append(h)
        offsets += (offsets[-1] + w[1:]).tolist()
        new, first = np.unique(h, return_index=True)
        spelled.update((k, bytes(data[s[i] : e[i]])) for k, i in zip(new.tolist(), first.tolist()) if k not in spelled)
    keys, token = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_inverse=True)
    texts.clear()
    del words, h, new, first, s, e, w, at
    release()
    data = np.frombuffer(b" " + b" ".join(spelled[k] for k in keys.tolist()) + b" ", np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(data)]), _SEP)
    del spelled
    grams: list[tuple[np.ndarray, np.ndarray]] = []  # word and bucket of each n-gram, by n
    per = np.zeros(len(keys), np.int64)
    for bucket, use in _grams(data, bits):
        i = np.flatnonzero(use)
        grams.append(((np.searchsorted(s, i + 1, "right") - 1).astype(np.int32), bucket[i].astype(np.int32)))
        per += np.bincount(grams[-1][0], minlength=len(keys))
    del data, bucket, use, i, s, e
    release()
    start, length, rows = _windows(np.array(offsets))
    token = np.unique(np.repeat(np.arange(len(start)), length) * max(len(keys), 1) + token)
    window_of, token = ((token // max(len(keys), 1)).astype(np.int32), (token % max(len(keys), 1)).astype(np.int32))
    divide = np.maximum(length, LEAST)
    row_of = np.repeat(np.arange(len(y)), np.diff(rows))
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    rng = np.random.default_rng(seed)
    emb, soft, bias = rng.normal(0, 0.01, (1 << bits, dim)).astype(np.float32), rng.normal(0, 0.3, (dim, 2)), np.array([1.5, -1.5])
    moments = [np.zeros_like(p) for p in (emb, soft, bias)]
    for t in range(1, rounds + 1):
        v = emb @ (soft[:, 1] - soft[:, 0])
        word = sum(np.bincount(w, weights=v[b], minlength=len(keys)) for w, b in grams) / per
        window = np.bincount(window_of, weights=word[token], minlength=len(start)) / divide
        if t <= rounds // 3:
            share = 1.0 / np.maximum(np.diff(rows), 1)[row_of]
        else:
            top = _segmented(np.maximum, window, rows, 0.0)
            hit = np.flatnonzero(window == top[row_of])
            share = np.zeros(len(start))
            share[hit[np.concatenate([[True], np.diff(row_of[hit]) > 0])]] = 1.0
        z = np.bincount(row_of, weights=window * share, minlength=len(y)) + bias[1] - bias[0]
        delta = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g_window = delta[row_of] * share / divide
        g_word = np.bincount(token, weights=g_window[window_of], minlength=len(keys)) / per
        g = sum(np.bincount(b, weights=g_word[w], minlength=1 << bits) for w, b in grams)
        down = g @ emb
        grads = (np.outer(g.astype(np.float32), (soft[:, 1] - soft[:, 0]).astype(np.float32)) + np.float32(1e-7) * emb, np.stack([-down, down], 1), np.array([-delta.sum(), delta.sum()]))
        for k, (p, grad, m) in enumerate(zip((emb, soft, bias), grads, moments)):
            m *= 0.9
            m += grad
            p -= (STEPS[k] * m).astype(p.dtype)
    v = emb @ (soft[:, 1] - soft[:, 0])
    word = sum(np.bincount(w, weights=v[b], minlength=len(keys)) for w, b in grams) / per
    window = np.bincount(window_of, weights=word[token], minlength=len(start)) / divide
    clean = window[y[row_of] == 0]
    above = clean[clean > np.quantile(clean, TAIL)] - np.quantile(clean, TAIL) if len(clean) else clean
    tail = float(above.mean()) if len(above) else 0.0
    return Model(v.astype(np.float32), float(bias[1] - bias[0]), bits, tail, float(max(np.diff(rows).mean(), 1)))


def _bound(sizes: list[int], room: int) -> int:
    """The largest bound such that texts of these sizes, cut to it, fit into `room`."""
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > room:
            return max(room // (len(sizes) - i), 1)
        room -= n
    return max(sizes, default=0)


def _cut(text: str, bound: int, seed: int) -> str:
    """`text`, or as many of its windows, drawn by `seed`, as have `bound` bytes together."""
    raw = text.encode()
    if len(raw) <= bound:
        return text
    words, taken = text.split(), {}
    for k in np.random.default_rng(seed).permutation(-(-len(words) // WINDOW)).tolist():
        piece = " ".join(words[k * WINDOW : (k + 1) * WINDOW])
        size = len(piece.encode()) + 1
        if size <= bound:
            bound -= size
            taken[k] = piece
    return " ".join(taken[k] for k in sorted(taken)) or raw[:bound].decode(errors="ignore")


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, *, per_class: int = 2000, max_bytes: int = 14 << 20, bits: int = BITS, dim: int = 8, rounds: int = 120, seed: int = 7) -> Model:
    """Learns `label` (1: toxic) of `labels` from the texts of `docs` with the same id."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    chosen = sorted(bounded(known, "y", "id", per_class, 2 * per_class)[0].collect(), key=lambda r: (r.y, r._draw, r.id))
    by = {k: [r for r in chosen if r.y == k][:per_class] for k in (0, 1)}
    texts = []
    if by[0] or by[1]:
        ship(spark)
        ids = spark.createDataFrame([(r.id, r.y, r._draw) for k in (0, 1) for r in by[k]], known.select("id", "y").schema.add("draw", "long"))
        # at most 2 * per_class ids, so the broadcast is bounded
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "id").select("y", "draw", "text")
        sizes = rows.select("y", F.octet_length("text").alias("n")).collect()
        bound = {k: _bound([r.n for r in sizes if r.y == k], max_bytes // 2) for k in (0, 1)}

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y, draw, whole = (c.to_pylist() for c in batch.columns)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([_cut(t, bound[k], d) for k, d, t in zip(y, draw, whole)], pa.string())], batch.schema.names)

        texts = [(r.y, r.draw, r.text) for r in rows.mapInArrow(cut, rows.schema).toLocalIterator()]
    return _fitted(texts, bits, dim, rounds, seed)


def _fitted(texts: list[tuple[int, int, str]], bits: int, dim: int, rounds: int, seed: int) -> Model:
    """The model of (label, draw, text); the order in which they come doesn't matter. The list is emptied."""
    texts.sort()
    y = np.array([t[0] for t in texts], np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(1 << bits, np.float32), float(np.clip(np.log(max(share, 1e-9)) - np.log(max(1 - share, 1e-9)), -20, 20)), bits)
    own = [t[2] for t in texts]
    texts.clear()
    model = _train(own, y, bits, dim, rounds, seed)
    # the driver lives on, with less room than an executor
    release()
    return model


def score(docs: DataFrame, id_col: str, text: str, model: Model, *, keep: list[str] | None = None) -> DataFrame:
    """(id, score) of every row of `docs`; 0 to 1, higher: likelier toxic. keep: other columns to return instead of the id.

    Only the text goes to Python, once, and only the score comes back.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for col in texts:
            z, blank = np.zeros(len(col)), np.ones(len(col), bool)
            for row, end, data, at in padded_chunks(col, " ", " "):
                s, e, w = word_spans(data, at, _SEP)
                word = _word_scores(data, s, e, m.v, m.bits)
                start, length, rows = _windows(w)
                window_of = np.repeat(np.arange(len(start)), length)
                _, once = np.unique(word_hashes(data, s, e) + mix(window_of.astype(np.uint64)), return_index=True)
                window = np.bincount(window_of[once], weights=word[once], minlength=len(start)) / np.maximum(length, LEAST)
                blank[row:end] = np.diff(rows) == 0
                z[row:end] = _segmented(np.maximum, window, rows, 0.0) - m.tail * np.log(np.maximum(np.diff(rows) / m.usual, 1))
            yield pa.array(np.where(blank, 0.0, 1 / (1 + np.exp(-np.clip(z + m.bias, -30, 30)))))

    # not deterministic as far as the optimizer knows, so that a filter on the score doesn't compute it twice
    once = F.arrow_udf(scored, "double").asNondeterministic()
    return docs.select(*[F.col(c) for c in ([id_col] if keep is None else keep)], once(F.col(text)).alias("score"))
