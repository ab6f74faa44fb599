"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

Tier 1 is a broadcast table from the corpus's frequent pre-tokens to their token counts (at most
`table_size` entries, `MAX_TABLE_BYTES` bytes). Tier 2 is a cache in each Python worker, filled by
the tokenizer itself on a miss and cleared at `CACHE_ENTRIES`. Both tiers only save work: every
count equals the tokenizer's own for the whole text.

Pre-tokens here are the pieces of a text between single spaces, each with its leading space.
A byte-level BPE pattern never looks across such a cut unless white space touches it, so texts
in which it does (double spaces, a space beside a line break, empty texts) are encoded whole.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); ids may be null or repeated, each
row is answered by itself; special strings inside texts are treated as the tokenizer's default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.text import buffers
from keytide.session import ship

TABLE_SIZE = 20_000
MAX_TABLE_BYTES = 8 << 20
CACHE_ENTRIES = 1_000_000
SUMMARY = 4_096
#: Longer pieces are rare by nature and never enter the table.
MAX_PIECE = 64
#: Characters that the pattern's \s matches.
WHITE = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0                　"
_EDGE = f"^$|^[{WHITE}]|[{WHITE}]$".replace("\t\n\x0b\x0c\r ", r"\t\n\x0b\x0c\r ")

#: Fixed value: the pattern by which byte-level BPE files split texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, tuple] = {}
_caches: dict[str, dict[str, int]] = {}


def _load(path: str) -> tuple:
    """The tokenizer, its special strings, and a quicker encoder of the same merges (None if the file isn't plain byte-level BPE)."""
    if path in _loaded:
        return _loaded[path]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    special = [x.content for x in whole.get_added_tokens_decoder().values()]
    config, quick = json.loads(whole.to_str()), None
    model, split = config["model"], config.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not config.get("normalizer") and not model.get("ignore_merges") and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    ids = [model["vocab"].get(m, -1) for m in joined] if plain else []
    if ids and ids == sorted(set(ids)) and len(ids) + 256 == len(model["vocab"]):
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in model["vocab"].items()}
        quick = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    _loaded[path] = whole, special, quick
    return _loaded[path]


def _encoded(path: str, texts: list[str], exact: bool = False) -> list[int]:
    """Token counts. exact: by the tokenizer's own code alone."""
    whole, special, quick = _load(path)
    if exact or quick is None:
        return [len(x.ids) for x in whole.encode_batch(texts, add_special_tokens=False)]
    odd = [i for i, x in enumerate(texts) if any(s in x for s in special)]
    out = [len(quick.encode_ordinary(x)) for x in texts]
    for i, n in zip(odd, _encoded(path, [texts[i] for i in odd], exact=True) if odd else []):
        out[i] = n
    return out


def _cached(path: str, texts: list[str]) -> np.ndarray:
    cache = _caches.setdefault(path, {})
    missing = list(dict.fromkeys(x for x in texts if x not in cache))
    if len(cache) + len(missing) > CACHE_ENTRIES:
        cache.clear()
        missing = list(dict.fromkeys(texts))
    cache.update(zip(missing, _encoded(path, missing)))
    out = np.fromiter(map(cache.__getitem__, texts), np.int64, len(texts))
    # long pieces seldom come again: without them the cache is bounded in bytes too
    for x in missing:
        if len(x) > MAX_PIECE:
            del cache[x]
    return out


def _runs(col: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, one row at least."""
    _, offsets = buffers(col)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end
        row = end


def _pieces(col: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The piece offsets of the rows, and the pieces as a dictionary."""
    col = col.fill_null("") if col.null_count else col
    lists = pc.split_pattern(col, " ")
    offsets = np.asarray(lists.offsets, np.int64)
    return offsets - offsets[0], lists.flatten().dictionary_encode()


def _edges(names: pa.Array) -> np.ndarray:
    """Pieces that are empty, or begin or end with white space."""
    data, offsets = buffers(names)
    if not len(names):
        return np.zeros(0, bool)
    full = offsets[1:] > offsets[:-1]
    first, last = np.full(len(names), 32, np.uint8), np.full(len(names), 32, np.uint8)
    first[full], last[full] = data[offsets[:-1][full]], data[offsets[1:][full] - 1]
    edge = ~full | (first <= 32) | (last <= 32)
    wide = np.flatnonzero((first >= 128) | (last >= 128))
    edge[wide] = np.asarray(pc.match_substring_regex(names.take(pa.array(wide)), _EDGE))
    return edge


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: its most frequent pieces and their counts."""
    counts: dict[str, int] = {}
    for batch in batches:
        for row, end in _runs(batch.column(0)):
            _, pieces = _pieces(batch.column(0).slice(row, end - row))
            n = np.bincount(np.asarray(pieces.indices), minlength=len(pieces.dictionary))
            top = np.flatnonzero(n >= 2)
            for piece, k in zip(pieces.dictionary.take(pa.array(top)).to_pylist(), n[top].tolist()):
                counts[piece] = counts.get(piece, 0) + k
            if len(counts) > 16 * SUMMARY:
                counts = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: 4 * SUMMARY])
    yield _summary(counts)


def _summary(counts: dict[str, int]) -> pa.RecordBatch:
    top = sorted(((p, n) for p, n in counts.items() if len(p) <= MAX_PIECE), key=lambda x: (-x[1], x[0]))[:SUMMARY]
    return pa.RecordBatch.from_pydict({"pieces": [[p for p, _ in top]], "counts": pa.array([[n for _, n in top]], pa.list_(pa.int64()))})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = {}
    for batch in batches:
        for pieces, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for p, k in zip(pieces, n):
                counts[p] = counts.get(p, 0) + k
    yield _summary(counts)


def frequent_pieces(df: DataFrame, text: str, size: int = TABLE_SIZE) -> list[str]:
    """The corpus's frequent pieces, from bounded summaries of every task over all texts, merged in a tree."""
    schema = "pieces array<string>, counts array<bigint>"
    parts = df.select(text).mapInArrow(_summaries, schema)
    n = parts.rdd.getNumPartitions()
    while n > 16:
        n = max(1, n // 16)
        parts = parts.repartition(n).mapInArrow(_merged, schema)
    total: dict[str, int] = {}
    for row in parts.toLocalIterator():
        for p, k in zip(row.pieces, row.counts):
            total[p] = total.get(p, 0) + k
    out, room = [], MAX_TABLE_BYTES
    for p in sorted(total, key=lambda p: (-total[p], p))[:size]:
        if (room := room - len(p.encode()) - 8) < 0:
            break
        out.append(p)
    return out


def count_tokens(df: DataFrame, id_col: str, text: str, tokenizer: str, *, limit: int = 512, table_size: int = TABLE_SIZE) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of `df`.

    `tokenizer` is the path of a byte-level BPE file on the executors; `limit` is the number of
    tokens beyond which a text counts as over the limit.
    """
    spark = df.sparkSession
    ship(spark)
    frequent = frequent_pieces(df, text, table_size)
    frequent = [p for p, edge in zip(frequent, _edges(pa.array(frequent, pa.string()))) if not edge]
    table = spark.sparkContext.broadcast((frequent, np.array(_encoded(tokenizer, [f" {p}" for p in frequent]), np.uint16)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = pa.array(table.value[0], pa.string()), table.value[1].astype(np.int64)
        for batch in batches:
            col, out = batch.column(1), np.zeros(len(batch), np.int64)
            col = col.fill_null("") if col.null_count else col
            for row, end in _runs(col):
                part = col.slice(row, end - row)
                offsets, pieces = _pieces(part)
                names, index = pieces.dictionary, np.asarray(pieces.indices)
                at = pc.index_in(names, value_set=known)
                n = np.full(len(names), -1, np.int64)
                hit = np.flatnonzero(np.asarray(at.is_valid()))
                n[hit] = lengths[np.asarray(at.fill_null(0))[hit]]
                edge = _edges(names)
                miss = np.flatnonzero((n < 0) & ~edge)
                n[miss] = _cached(tokenizer, [f" {p}" for p in names.take(pa.array(miss)).to_pylist()])
                n[edge] = 0
                per = np.add.reduceat(n[index], offsets[:-1])
                whole = np.add.reduceat(edge[index].astype(np.int64), offsets[:-1]) > 0
                first = index[offsets[:-1]]
                plain = np.flatnonzero(~whole)
                per[plain] += _cached(tokenizer, names.take(pa.array(first[plain])).to_pylist()) - n[first[plain]]
                for i in np.flatnonzero(whole).tolist():
                    per[i] = _encoded(tokenizer, [part[i].as_py()])[0]
                out[row:end] = per
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], ["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"))
    return rows.mapInArrow(counted, f"id {kind}, n_bytes bigint, n_tokens bigint").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
