"""Line dedup by pairwise alignment: aligned common blocks go from the later document.

Lines end at line feeds and are compared without white space around them, by a 64-bit hash. Two documents
are a pair if they share a window: adjacent lines that have `min_chars` characters together. A line is deleted if an
alignment with any earlier document of a pair puts it into a block of `min_chars` characters or more, so into
a window around it; the shortest windows around each line therefore propose all partners that matter. They
do so in rounds: first each window's first holder, then, for the lines no alignment has covered yet, ever
larger groups of the holders after it, until no line is open. A line that a third of all documents share
costs a pair for each of them as long as the first holder's alignment covers it. Documents of equal shared lines, equally
adjacent, are one partner, the first, which also covers all that the others can lose. No cut by document frequency drops cases.

Rarity works where it does in a patience diff: the alignment of a
pair is anchored on lines that occur once in both, then goes on between the anchors; where no such line
is left, the k-th occurrences of a line are matched. Runs of aligned lines that are adjacent in both documents are blocks; blocks of
`min_chars` characters or more are deleted from the later document. Alignments are
judged on the input, not on what other pairs leave.

Only hashes of shared lines travel: a pair is aligned on them alone, as other lines can't match.

Documents are ordered by id (null last), then by row. Defined cases: a null text has no lines and stays
null; an empty text has one blank line; blank lines are never matched, and one is deleted with the
line before it; repeated ids and rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytide.session import discard, ship, small, steady, written

MIN_CHARS = 20
#: Each round but the first tries so many times as many holders of a window as the one before.
WIDER = 4


def _increasing(ranks: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails, ends, before = [], [], []
    for i, r in enumerate(ranks):
        at = bisect_left(tails, r)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(r)
            ends.append(i)
        else:
            tails[at], ends[at] = r, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if na[x] == 1}
        anchors = [(place[x], j) for j, x in enumerate(b[b0:b1], b0) if nb[x] == 1 and x in place]
        last = not anchors
        if last:  # no line occurs once in both: match k-th occurrences
            seen: Counter = Counter()
            numbered = {}
            for i, x in enumerate(a[a0:a1], a0):
                numbered[x, seen[x]] = i
                seen[x] += 1
            seen = Counter()
            for j, x in enumerate(b[b0:b1], b0):
                if (x, seen[x]) in numbered:
                    anchors.append((numbered[x, seen[x]], j))
                seen[x] += 1
        chosen = [anchors[i] for i in _increasing([x for x, _ in anchors])]
        out += chosen
        if not last:
            edges = [(a0 - 1, b0 - 1), *chosen, (a1, b1)]
            todo += [(x0 + 1, x1, y0 + 1, y1) for (x0, y0), (x1, y1) in zip(edges, edges[1:])]
    return sorted(out)


def common_blocks(a: list[tuple[int, int, int]], b: list[tuple[int, int, int]], min_chars: int) -> list[int]:
    """Line numbers of b in aligned blocks of enough characters. Lines are (number, hash, characters)."""
    out, block, chars = [], [], 0
    before = None
    for i, j in [*patience([x[1] for x in a], [x[1] for x in b]), (None, None)]:
        here = None if i is None else (a[i][0], b[j][0])
        if before is None or here is None or here != (before[0] + 1, before[1] + 1):
            if chars >= min_chars:
                out += block
            block, chars = [], 0
        if here is not None:
            block.append(here[1])
            chars += b[j][2]
        before = here
    return out


def windows(lines: list[tuple[int, int, int]], min_chars: int) -> list[tuple[int, int]]:
    """(line number, hash) of the shortest runs of adjacent lines around each line that have enough characters."""
    out = []
    total = list(accumulate((c for _, _, c in lines), initial=0))
    low = 0
    ends = [k for k in range(1, len(lines) + 1) if k == len(lines) or lines[k][0] != lines[k - 1][0] + 1]
    for high in ends:
        for k in range(low, high):
            start, end = k, high + 1
            while start >= low and end > k + 1:
                here = max(k + 1, bisect_left(total, total[start] + min_chars))
                if here <= high and here < end:
                    out.append((lines[k][0], lines[k][1] if here == start + 1 else hash(tuple(h for _, h, _ in lines[start:here]))))
                    end = here
                start -= 1
        low = high
    return out


def _kinds(batches: Iterator[pd.DataFrame], min_chars: int) -> Iterator[pd.DataFrame]:
    """Of each document's lines a digest that equal sequences have, equally adjacent, and the windows."""
    for pdf in batches:
        kind, at, key = [], [], []
        for found in pdf["lines"]:
            lines = [(r["n"], r["h"], r["c"]) for r in found]
            steps = [x[0] - y[0] == 1 for x, y in zip(lines[1:], lines)]
            kind.append(hashlib.blake2b(repr(([x[1] for x in lines], steps)).encode(), digest_size=16).digest())
            own = windows(lines, min_chars)
            at.append([n for n, _ in own])
            key.append([h for _, h in own])
        yield pd.DataFrame({"_rid": pdf["_rid"], "kind": kind, "at": at, "key": key})


def _aligned(batches: Iterator[pd.DataFrame], min_chars: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        gone = [common_blocks([(r["n"], r["h"], r["c"]) for r in a], [(r["n"], r["h"], r["c"]) for r in b], min_chars) for a, b in zip(pdf["a"], pdf["b"])]
        yield pd.DataFrame({"_rid": pdf["_rid"], "gone": gone})


def _covered(found: DataFrame, per: DataFrame, min_chars: int) -> DataFrame:
    """(_rid, p) of the lines that go from every document of `found` whose windows' first holders, and those after them, align them."""
    held = written(per.mapInPandas(lambda x: _kinds(x, min_chars), "_rid bigint, kind binary, at array<int>, key array<bigint>").where(F.size("at") > 0), "document-windows")
    held = held.join(found.select("_rid", "o").distinct(), "_rid")
    several = held.groupBy("kind").agg(F.min("o").alias("rep"), F.max("o").alias("last")).where("rep <> last").select("kind", F.col("rep._rid").alias("rep"))
    held = written(held.join(several, "kind", "left").select("_rid", "o", "rep", "at", "key"), "document-kinds")
    copies = held.where("rep <> _rid").select("_rid", F.col("rep").alias("owner"))
    keys = held.where("rep is null or rep = _rid").select("_rid", "o", F.explode(F.arrays_zip("at", "key")).alias("w")).select("_rid", "o", F.col("w.at").alias("p"), F.col("w.key").alias("k"))
    first = keys.groupBy("k").agg(F.min("o").alias("first"), F.max("o").alias("last")).where("first <> last").select("k", F.col("first._rid").alias("owner"))
    keys = written(keys.join(first, "k"), "shared-windows")
    later = per.select("_rid", F.col("lines").alias("b"))
    owners = per.select(F.col("_rid").alias("owner"), F.col("lines").alias("a"))

    def align(pairs: DataFrame) -> DataFrame:
        out = pairs.distinct().join(later, "_rid").join(owners, "owner").select("_rid", "a", "b").mapInPandas(lambda x: _aligned(x, min_chars), "_rid bigint, gone array<int>")
        return written(out.select("_rid", F.explode("gone").alias("p")).distinct(), "aligned-lines")

    pairs = keys.where("owner <> _rid").select("_rid", "owner")
    gone = align(pairs.union(copies))
    still = written(keys.where("owner <> _rid").select("_rid", "p", "k").join(gone, ["_rid", "p"], "left_anti"), "open-lines")
    if still.isEmpty():
        return gone
    holders = keys.join(still.select("k").distinct(), "k", "left_semi").select("k", "_rid", "o").distinct()
    holders = written(holders.select("k", "_rid", F.row_number().over(Window.partitionBy("k").orderBy("o")).alias("r")), "window-holders")
    still = still.join(holders, ["k", "_rid"])
    low, high = 2, 1 + WIDER
    while True:
        still = written(still.where(F.col("r") > low), "open-lines")
        if still.isEmpty():
            return gone
        some = holders.where(F.col("r").between(low, high)).select("k", F.col("_rid").alias("owner"), F.col("r").alias("s"))
        more = align(still.join(some, "k").where("s < r").select("_rid", "owner"))
        gone = gone.union(more)
        still = still.join(more, ["_rid", "p"], "left_anti")
        low, high = high + 1, high + WIDER * (high - low + 1)


def dedup_lines(docs: DataFrame, id_col: str, text: str, *, keep: list[str] | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """The columns `keep` of `docs` (all by default) with _text (what is left), _n_lines and _n_removed."""
    ship(docs.sparkSession)
    docs = steady(docs)
    kept = docs.columns if keep is None else keep
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).alias("_id"), F.col(text).alias("_in"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)])
    lines = rows.select("_rid", "_id", F.posexplode(F.split("_in", "\n")).alias("p", "line")).select("_rid", "_id", "p", F.trim(F.translate("line", "\t\r\x0b\x0c", "    ")).alias("line"))
    lines = lines.where("line <> ''").select("_rid", "_id", "p", F.xxhash64("line").alias("h"), F.length("line").alias("c"))
    order = F.struct(F.col("_id").isNull().alias("no"), "_id", "_rid")
    # a line repeated within one document only isn't shared
    shared = lines.groupBy("h").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("h")
    found = written(lines.join(shared, "h").select("_rid", order.alias("o"), "p", "h", "c"), "shared-lines")
    per = found.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct(F.col("p").alias("n"), "h", "c"))).alias("lines"))
    per = written(per, "shared-per-document")
    gone = written(_covered(found, per, min_chars).groupBy("_rid").agg(F.sort_array(F.collect_set("p")).alias("gone")), "gone-lines")
    discard(found, per)
    n, m = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    out = rows.join(small(gone, 64 * n + 4 * m), "_rid", "left").withColumn("_lines", F.split("_in", "\n"))
    # a blank line goes with the line before it; blank lines aren't in `gone` themselves, so the order stays
    blank = lambda i: F.coalesce(F.trim(F.translate(F.get("_lines", i), "\t\r\x0b\x0c", "    ")) == "", F.lit(False))
    out = out.withColumn("_gone", F.flatten(F.transform("gone", lambda i: F.when(blank(i + 1), F.array(i, i + 1)).otherwise(F.array(i)))))
    # what stands between two lines that go stays
    before, after = F.concat(F.array(F.lit(-1)), "_gone"), F.concat("_gone", F.array(F.size("_lines")))
    left = F.flatten(F.zip_with(before, after, lambda x, y: F.slice("_lines", x + 2, y - x - 1)))
    return out.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)],
        F.when(F.col("gone").isNull(), F.col("_in")).otherwise(F.array_join(left, "\n")).alias("_text"),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("_n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("_n_removed"),
    )
