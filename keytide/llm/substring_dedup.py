"""Substring dedup by suffix automata of reference shards.

A window is `width` consecutive words. Words that a repeated window covers are removed; a window is repeated
if its words also start anywhere else, in the same document or another.

1. Each window has a minimiser: of its grams of `GRAM` words the one with the smallest hash. Neighbouring
   windows with one minimiser are a segment. Equal windows have equal minimisers, so a segment whose minimiser
   occurs once in the corpus has no repeated window; such segments, most of them, end here: only
   minimisers travel, a row for about a dozen words.
2. The other segments are cut from the texts. Equal segments are one reference, with their number. Where a
   minimiser has more than `HOT` references, its segments are cut again by the minimisers of other hashes, at
   last window by window, so no group of segments grows without bound.
3. References are dealt to shards by minimiser, about `SHARD_WORDS` words each. A task builds the suffix
   automaton of its shard, words as symbols, each end weighted by its number of occurrences, and streams the
   shard's references through it: matching statistics give the state of the `width` words that end at each
   position, and its weight tells whether the window occurs again.
4. The covered spans go back to every document that has the segment, and texts are rebuilt.

To send every document through every shard would cost documents times shards, and to broadcast the automata in
batches costs more than the texts they come from; minimisers bring each segment to the one automaton that can match
it, so all passes are linear. Spans are judged on the input.

Words are compared by 64-bit hashes, segments by two of them (see `text`).

Defined cases: null texts have no words; texts of fewer words than `width` keep all; repeated rows are documents
of their own, so all their windows are repeated; null ids are kept; extra columns aren't read; an empty table gives an
empty result; a very long text is a row like others, its hashes taken in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.text import chunks, lowest, mix, rolled, word_hashes, word_spans
from keytide.session import discard, ship, small, steady, written

WIDTH = 35
GRAM = 12
SHARD_WORDS = 60_000
#: References of one minimiser, beyond which its segments are cut again, and how often before single windows.
HOT = 1_000
LEVELS = 2
#: Windows' segments of one minimiser, beyond which it is looked up by a broadcast.
COMMON = 2_000


def segments(col: pa.Array, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, windows, minimiser) of the segments of whole texts, in order."""
    out: list[tuple] = []
    for row, _, data, offsets in chunks(col):
        starts, ends, at = word_spans(data, offsets)
        n = len(starts) - width + 1
        if n <= 0:
            continue
        grams = rolled(word_hashes(data, starts, ends), gram)
        least = lowest(grams, width - gram + 1)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        valid = np.flatnonzero(doc[:n] == doc[width - 1 :])
        if not len(valid):
            continue
        p, d = least[valid], doc[valid]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])]))
        own = valid[first]
        out.append((row + doc[own], own - at[doc[own]], np.diff(np.concatenate([first, [len(valid)]])), grams[p[first]].view(np.int64)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


class Automaton:
    """A suffix automaton of several word sequences; weights count the ends of occurrences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.weight = [-1], [0], [0]

    def add(self, words: list, weight: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            if w in nxt[last]:
                q = nxt[last][w]
                if length[q] != length[last] + 1:
                    q = self._split(last, q, w)
                last = q
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                self.weight.append(0)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
                last = cur
            self.weight[last] += weight

    def _split(self, p: int, q: int, w: object) -> int:
        nxt, link = self.next, self.link
        clone = len(nxt)
        nxt.append(nxt[q].copy())
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.weight.append(0)
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def close(self) -> None:
        """Adds each state's weight to its suffixes'."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.weight[self.link[s]] += self.weight[s]

    def compact(self, vocabulary: np.ndarray) -> Compact:
        """The closed automaton as arrays; its symbols are places in `vocabulary`."""
        number = np.fromiter(map(len, self.next), np.int64, len(self.next))
        state = np.repeat(np.arange(len(number)), number)
        key = state * len(vocabulary) + np.fromiter(chain.from_iterable(self.next), np.int64, len(state))
        to = np.fromiter(chain.from_iterable(x.values() for x in self.next), np.int32, len(state))
        order = np.argsort(key)
        link = np.array(self.link, np.int32)
        link[0] = 0
        return Compact(vocabulary, key[order], to[order], link, np.array(self.length, np.int32), np.array(self.weight) >= 2)


@dataclass
class Compact:
    """A suffix automaton as arrays. A transition is the key state * symbols + symbol, in order, and its target; the root links to itself."""

    vocabulary: np.ndarray
    key: np.ndarray
    to: np.ndarray
    link: np.ndarray
    length: np.ndarray
    again: np.ndarray

    def repeated(self, words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Which words end a window that occurs at least twice. Texts are words[at[i]:at[i + 1]]; all go on word by word together."""
        symbol = np.searchsorted(self.vocabulary, words)
        symbol[symbol == len(self.vocabulary)] = 0
        known = self.vocabulary[symbol] == words
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        longer = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")  # how many texts have a k-th word
        state, matched = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
        out = np.zeros(len(words), bool)
        for k, n in enumerate(longer.tolist()):
            here = at[:-1][order[:n]] + k
            s, m = state[:n], matched[:n]
            todo = np.arange(n)
            while len(todo):
                key = s[todo].astype(np.int64) * len(self.vocabulary) + symbol[here[todo]]
                i = np.searchsorted(self.key, key)
                i[i == len(self.key)] = 0
                ok = (self.key[i] == key) & known[here[todo]]
                s[todo[ok]] = self.to[i[ok]]
                m[todo[ok]] += 1
                todo = todo[~ok]
                m[todo] = 0
                todo = todo[self.length[s[todo]] > 0]
                s[todo] = self.link[s[todo]]
                m[todo] = self.length[s[todo]]
            while len(up := np.flatnonzero(self.length[self.link[s]] >= width)):
                s[up] = self.link[s[up]]
                m[up] = self.length[s[up]]
            out[here] = (m >= width) & self.again[s]
        return out


def _hashed(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the texts' word offsets."""
    words, at = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, data, offsets in chunks(col):
        starts, ends, own = word_spans(data, offsets)
        words.append(word_hashes(data, starts, ends))
        at.append(own[1:] + at[-1][-1])
    return np.concatenate(words), np.concatenate(at)


def _judged(part: pa.Table, width: int) -> pa.Table:
    """Of each reference of a shard with repeated windows: its key and the covered spans: start, end, start, end ..."""
    part = part.sort_by([("one", "ascending"), ("two", "ascending")])
    words, at = _hashed(part["segment"])
    vocabulary, symbol = np.unique(words, return_inverse=True)
    automaton, symbol = Automaton(), symbol.tolist()
    for a, b, n in zip(at.tolist(), at[1:].tolist(), part["number"].to_pylist()):
        automaton.add(symbol[a:b], n)
    automaton.close()
    del symbol
    ends = np.flatnonzero(automaton.compact(vocabulary).repeated(words, at, width))
    of = np.searchsorted(at, ends, "right") - 1
    # windows that touch are one span
    new = np.concatenate([[True], (np.diff(ends) > width) | (np.diff(of) > 0)]) if len(ends) else np.zeros(0, bool)
    last = np.concatenate([new[1:], [True]]) if len(ends) else new
    row = of[new]
    spans = np.stack([ends[new] - width + 1 - at[row], ends[last] + 1 - at[row]], 1).astype(np.int32).reshape(-1)
    rows, first = np.unique(row, return_index=True)
    found = pa.ListArray.from_arrays(pa.array(np.concatenate([2 * first, [len(spans)]]), pa.int32()), pa.array(spans))
    return pa.table({"one": part["one"].take(pa.array(rows)), "two": part["two"].take(pa.array(rows)), "spans": found})


def _cut_again(batch: pa.RecordBatch, width: int, gram: int, level: int) -> pa.RecordBatch:
    """Segments (_rid, start, gram, segment) cut by the minimisers of another hash; on the last level each window is one."""
    words, at = _hashed(batch.column(3))
    rids, starts, grams, texts = [], [], [], []
    for i, (rid, start, g, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
        own = words[at[i] : at[i + 1]]
        salt = mix(np.array([g], np.int64).view(np.uint64) + np.uint64(level + 1))
        if level < LEVELS:
            code = mix(rolled(own, gram) ^ salt)
            at_least = lowest(code, width - gram + 1)
            key = code[at_least]
            first = np.flatnonzero(np.concatenate([[True], at_least[1:] != at_least[:-1]]))
        else:
            key = rolled(own, width)
            first = np.arange(len(key))
        key = mix(key ^ salt).view(np.int64)
        spelled = text.split(" ")
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
            rids.append(rid)
            starts.append(start + a)
            grams.append(int(key[a]))
            texts.append(" ".join(spelled[a : b + width - 1]))
    return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(starts, pa.int32()), pa.array(grams, pa.int64()), pa.array(texts, pa.string())], batch.schema.names)


def _ordinals(row: np.ndarray) -> np.ndarray:
    """The number of each segment within its row; rows are in order."""
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    at = np.arange(len(row))
    return at - np.maximum.accumulate(np.where(first, at, 0)) if len(row) else at


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces, so that no more than a piece's texts are Python objects at a time."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def repeated_spans(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """(_rid, spans) of the documents of rows (_rid, _text) with repeated windows; spans are disjoint: start, end, start, end ..."""

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, _, _, g = segments(b.column(1), width, gram)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), b.column(0).take(pa.array(row)), pa.array(_ordinals(row), pa.int32())], ["gram", "_rid", "number"])

    found = written(rows.mapInArrow(minimisers, "gram bigint, _rid bigint, number int"), "minimisers")
    twice = written(found.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"), "repeated-minimisers")
    # minimisers of very many windows are few, and are looked up without a shuffle, so that none of them fills a task
    common = twice.where(F.col("k") > COMMON).select("gram")
    common = small(common, 32 * common.count())
    rest = found.join(common, "gram", "left_anti").join(twice.where(F.col("k") <= COMMON).select("gram"), "gram")
    kept = found.join(common, "gram", "left_semi").select("_rid", "number").union(rest.select("_rid", "number"))
    # four bytes a segment: its number within the document; the cut itself is found again in the text
    wanted = written(kept.groupBy("_rid").agg(F.array_sort(F.collect_list("number")).alias("numbers")), "candidates")
    n, m = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("numbers")), F.lit(0))).first()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            row, start, n, g = segments(b.column(1), width, gram)
            at = np.searchsorted(row, np.arange(len(b)))
            take = np.concatenate([np.zeros(0, np.int64), *[at[i] + np.asarray(x.values) for i, x in enumerate(b.column(2))]])
            text = []
            own, words = -1, []
            for k in take.tolist():
                if row[k] != own:
                    own = row[k]
                    words = b.column(1)[int(own)].as_py().encode().split()
                text.append(b" ".join(words[start[k] : start[k] + n[k] + width - 1]).decode())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[take])), pa.array(start[take], pa.int32()), pa.array(g[take], pa.int64()), pa.array(text, pa.string())], ["_rid", "start", "gram", "segment"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for starts, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                own: list[int] = []
                for x, y in sorted((start + x, start + y) for start, found in zip(starts, spans) for x, y in zip(found[::2], found[1::2])):
                    if own and x <= own[-1]:
                        own[-1] = max(own[-1], y)
                    else:
                        own += [x, y]
                out.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["_rid", "spans"])

    schema = "_rid bigint, start int, gram bigint, segment string"
    cuts = rows.join(small(wanted, 40 * n + 4 * m), "_rid").select("_rid", "_text", "numbers").mapInArrow(cut, schema)
    tables = [written(cuts, "segments")]
    discard(found, twice, wanted)
    parts = []
    for level in range(LEVELS + 1):
        own = tables[-1]
        per = own.select("gram", F.xxhash64("segment").alias("one")).distinct().groupBy("gram").count()
        hot = written(per.where(F.col("count") > HOT).select("gram"), "hot-minimisers")
        if not (k := hot.count()):
            break
        hot = small(hot, 32 * k)
        again = own.join(hot, "gram", "left_semi").select(*own.columns).mapInArrow(lambda x, level=level: (_cut_again(b, width, gram, level) for b in _slices(x)), schema)
        parts.append(own.join(hot, "gram", "left_anti").select(*own.columns))
        tables.append(written(again, "segments"))
    cuts = tables[-1]
    for part in parts:
        cuts = cuts.union(part)
    # equal texts have equal minimisers on every level
    cuts = cuts.withColumn("one", F.xxhash64("segment")).withColumn("two", F.xxhash64("segment", F.lit(2)))
    references = cuts.groupBy("one", "two").agg(F.first("gram").alias("gram"), F.first("segment").alias("segment"), F.count("*").alias("number"))
    # a reference adds about as many words as a segment has windows
    shards = max(1, -(-m * gram // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard")
    judged = references.select(shard, "one", "two", "segment", "number").groupBy("shard").applyInArrow(lambda t: _judged(t, width), "one bigint, two bigint, spans array<int>")
    per = cuts.select("_rid", "start", "one", "two").join(judged, ["one", "two"]).groupBy("_rid").agg(F.collect_list("start").alias("starts"), F.collect_list("spans").alias("spans"))
    out = written(per.mapInArrow(merged, "_rid bigint, spans array<int>"), "spans")
    discard(*tables)
    return out


def dedup_substrings(docs: DataFrame, id_col: str, text: str, *, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, kept, kept_sha256) of every document; kept words are joined by one space."""
    if not 0 < gram <= width:
        raise ValueError("a gram has 1 to `width` words")
    ship(docs.sparkSession)
    rows = steady(docs.select(id_col, text)).select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    spans = repeated_spans(rows.select("_rid", "_text"), width, gram)
    n, m = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            total, gone, kept, sha = [], [], [], []
            for t, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = t.encode().split()
                left, at = [], 0
                own = own or []
                for a, b_ in zip(own[::2], own[1::2]):
                    left += words[at:a]
                    at = b_
                left += words[at:]
                out = b" ".join(left)
                total.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(out.decode())
                sha.append(hashlib.sha256(out).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], ["id", "n_words", "n_removed", "kept", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.join(small(spans, 40 * n + 4 * m), "_rid", "left").select("_id", "_text", "spans")
    return out.mapInArrow(rebuilt, f"id {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string").withColumnRenamed("id", id_col)
