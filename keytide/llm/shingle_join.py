"""N-gram Jaccard join by vertical partitioning.

The global order of the n-grams (5-word shingles, by a 64-bit hash) is cut into fragments of even size. Fragments
count on their own: first how many of a document's shingles any other text shares, later how much each
candidate pair overlaps; sums over the fragments are exact.

1. Shingle hashes go to their fragments as packed arrays, a row for each fragment and batch of documents that
   have shingles in it: 4 bytes a shingle and 2 for the document's place in its batch, so a fragment's size follows
   from its shingles, not from the number of documents. A fragment returns, packed again, how many of each
   document's shingles another text has too. A document that shares less than the threshold's part of its set can't
   link: it is done. The same pass makes the sets' signatures; documents with equal sets are a class, and one
   of them stands for all.
2. The sets of the classes that are left are made once more and written.
3. They go to the fragments with whole hashes, which return those that several sets have, and how many.
   In the order (number, hash), two linked sets share a shingle among their first
   n - ceil(t n) + 1: the prefix index. Of its entries with the same members one is kept.
4. Candidates come from the index in rounds: each shingle offers its members a few hubs; pairs inside a component found
   so far are left out; a few fragments count the partial overlaps and their sum decides a link. Large groups of
   near copies thus need about a pair for each member. Pairs are dealt out by bytes of their sets, so a task's memory doesn't grow with the table.
5. Where an index entry still holds several components, all its members outside the largest one are probed against
   all its members of other components. The order is cut into `NARROW` fragments; the sum of the smaller of two sets' numbers in each bounds their
   overlap, and pairs that it rules out never become rows. Of the others, first the likeliest of each component is tested as in 4, then,
   with the components this gives, all that are left. No pair of the index is left out.
6. Connected components of the links, and the classes' members, give each document its component.

Defined cases: null texts, empty texts and texts without words have an empty set and are linked with nothing; fewer words than
five are one shingle, the whole sequence; equal rows are linked by their equal sets; the component of rows with null ids is
null if no member has an id, else the smallest id; other columns aren't read; a very long text is one set like others;
an empty table gives an empty result. Shingles are compared by 64-bit hashes, sets by two sums of them (see `text`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.components import components
from keytide.llm.text import chunks, lowered, mix, release, rolled, word_hashes, word_spans
from keytide.session import discard, ship, small, steady, written

WIDTH = 5
#: Shingles of a fragment, and of a batch of packed rows, about.
FRAGMENT = 1_000_000
PACKED = 1_000_000
#: Shingles of an Arrow batch, about: what larger ones take outside the heap doesn't come back.
SENT = 250_000
#: Documents of a packed row: their places have 16 bits.
PLACES = 1 << 16
#: Fragments in which pairs are verified, and the most pairs and shingles of a task there, about.
WIDE = 8
PAIRS = 50_000
SEGMENTS = 1_000_000
#: Fragments whose numbers of shingles bound an overlap.
NARROW = 256
HUBS = (1, 4)


def shingle_sets(col: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for row, end, data, offsets in chunks(col):
        data = lowered(data)
        starts, ends, at = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        grams = rolled(words, width)
        for i in range(end - row):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= width:
                x = np.sort(grams[a : b - width + 1])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x
            elif b > a:
                yield rolled(words[a:b], b - a) + np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def _cuts(x: np.ndarray, fragments: int) -> np.ndarray:
    """Where sorted hashes pass from fragment to fragment."""
    step = (1 << 64) // fragments
    return np.concatenate([[0], np.searchsorted(x, np.array([step * f for f in range(1, fragments)], np.uint64)), [len(x)]])


HEAD = np.dtype([("rid", np.int64), ("n", np.int64), ("one", np.int64), ("two", np.int64)])
PACKED_SCHEMA = "fragment int, batch bigint, heads binary, docs binary, codes binary"


def _packed(rids: list[int], sets: list[np.ndarray], fragments: int, code: np.dtype) -> pa.RecordBatch:
    """A batch's rows, one for each fragment that has some of its shingles; the first of them has the heads: row numbers, sizes and signatures."""
    heads = np.zeros(len(rids), HEAD)
    heads["rid"] = rids
    heads["n"] = [len(x) for x in sets]
    for k, salt in (("one", 0), ("two", 0x5555555555555555)):
        heads[k] = np.array([mix(x ^ np.uint64(salt)).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
    every = np.concatenate(sets)
    places = np.repeat(np.arange(len(sets), dtype=np.uint16), heads["n"])
    fragment = np.minimum(every // np.uint64((1 << 64) // fragments), np.uint64(fragments - 1)).astype(np.int32) if fragments > 1 else np.zeros(len(every), np.int32)
    order = np.argsort(fragment, kind="stable")
    every, places, fragment = every[order], places[order], fragment[order]
    codes = mix(every).astype(code) if code == np.uint32 else every
    first = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]])) if len(every) else np.zeros(1, np.int64)
    ends = [*first[1:].tolist(), len(every)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(fragment[first] if len(every) else np.zeros(1, np.int32)),
            pa.array(np.full(len(first), rids[0], np.int64)),
            pa.array([heads.tobytes() if k == 0 else b"" for k in range(len(first))], pa.binary()),
            pa.array([places[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary()),
            pa.array([codes[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary()),
        ],
        ["fragment", "batch", "heads", "docs", "codes"],
    )


def _packs(rows: Iterator[tuple[int, np.ndarray]], fragments: int, code: np.dtype) -> Iterator[pa.RecordBatch]:
    rids, sets, size = [], [], 0
    for rid, x in rows:
        rids.append(rid)
        sets.append(x)
        size += len(x) + 16
        if size >= PACKED or len(rids) == PLACES:
            yield from _sent(_packed(rids, sets, fragments, code))
            rids, sets, size = [], [], 0
    if rids:
        yield from _sent(_packed(rids, sets, fragments, code))
    del rids, sets
    release()


def _sent(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `SENT` shingles, a row at least."""
    step = max(1, SENT * batch.num_rows * 8 // max(batch.nbytes, 1))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def _unpacked(part: pa.Table, name: str, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for c in part[name].chunks for x in c]


def _counts(codes: np.ndarray) -> np.ndarray:
    """How often each code occurs, at all its places."""
    order = np.argsort(codes, kind="stable")
    x = codes[order]
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
    out = np.empty(len(x), np.int32)
    out[order] = np.repeat(np.diff(edge), np.diff(edge))
    return out


def _shared(part: pa.Table, code: np.dtype, hashes: bool) -> pa.Table:
    """By batch: of each document the number of codes that another has too; hashes: these codes themselves and their numbers of documents."""
    release()
    docs, codes = _unpacked(part, "docs", np.uint16), _unpacked(part, "codes", code)
    count = _counts(np.concatenate(codes))
    at, out = 0, []
    for batch, heads, d, c in zip(part["batch"].to_pylist(), part["heads"].to_pylist(), docs, codes):
        own = count[at : at + len(d)]
        at += len(d)
        hit = own > 1
        if not heads and not hit.any():
            continue
        if hashes:
            out.append((batch, heads, d[hit].tobytes(), c[hit].tobytes(), own[hit].tobytes()))
        else:
            place, n = np.unique(d[hit], return_counts=True)
            out.append((batch, heads, place.tobytes(), b"", n.astype(np.int32).tobytes()))
    return pa.Table.from_batches(_sent(pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(SHARED.types)], schema=SHARED)), SHARED)


SHARED = pa.schema([("batch", pa.int64()), *((c, pa.binary()) for c in ("heads", "docs", "codes", "counts"))])
SHARED_SCHEMA = "batch bigint, heads binary, docs binary, codes binary, counts binary"


def _known(part: pa.Table, percent: int) -> pa.Table:
    """(_rid, n, one, two, left) of a batch's documents; left: they share enough of their set to link."""
    release()
    heads = next(np.frombuffer(h, HEAD) for h in part["heads"].to_pylist() if h)
    total = np.zeros(len(heads), np.int64)
    for d, n in zip(_unpacked(part, "docs", np.uint16), _unpacked(part, "counts", np.int32)):
        total[d] += n
    left = (heads["n"] > 0) & (100 * total >= percent * heads["n"])
    return pa.table({"_rid": heads["rid"], "n": heads["n"], "one": heads["one"], "two": heads["two"], "left": left})


def _prefixes(part: pa.Table, percent: int) -> pa.Table:
    """(h, cls, n) of a batch: each set's first shingles in the order (number of sets, hash). Those of one set alone come first and are left out."""
    release()
    heads = next(np.frombuffer(h, HEAD) for h in part["heads"].to_pylist() if h)
    doc, h, count = (np.concatenate(_unpacked(part, c, k)) for c, k in (("docs", np.uint16), ("codes", np.uint64), ("counts", np.int32)))
    order = np.lexsort((h, count, doc))
    doc, h = doc[order].astype(np.int64), h[order]
    shared = np.bincount(doc, minlength=len(heads))
    n = heads["n"]
    take = np.maximum(n - -(-percent * n // 100) + 1 - (n - shared), 0)
    rank = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(shared)])[doc]
    doc, h = doc[rank < take[doc]], h[rank < take[doc]]
    return pa.table({"h": h.view(np.int64), "cls": heads["rid"][doc], "n": n[doc]})


def _overlaps(segments: pa.Table, pairs: pa.Table) -> pa.Table:
    """Partial overlaps of the pairs in one fragment."""
    release()
    own = {c: np.frombuffer(s, np.uint64) for c, s in zip(segments["cls"].to_pylist(), segments["segment"].to_pylist())}
    a, b, out = pairs["a"].to_pylist(), pairs["b"].to_pylist(), []
    none = np.zeros(0, np.uint64)
    for i, j in zip(a, b):
        x, y = own.get(i, none), own.get(j, none)
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        out.append(int((y[at] == x).sum()) if len(y) else 0)
    return pa.table({"a": pairs["a"], "b": pairs["b"], "common": pa.array(out, pa.int64())})


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb, by) whose partial overlaps add up to a link. by: the one of a and b that has few pairs."""
    number, shingles = pairs.agg(F.count("*"), F.sum(F.col("na") + F.col("nb"))).first()
    fragments = max(1, min(WIDE, -(-shingles // FRAGMENT)))
    groups = max(1, -(-number // PAIRS), -(-shingles // (fragments * SEGMENTS)))
    group = F.pmod(F.xxhash64("by"), F.lit(groups))
    here = pairs.select(F.col("a").alias("_rid"), group.alias("g")).union(pairs.select("b", group)).groupBy("_rid").agg(F.collect_set("g").alias("gs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for rid, hashes, gs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                x = np.frombuffer(hashes.as_buffer(), np.uint64)
                at = _cuts(x, fragments)
                for f in np.flatnonzero(np.diff(at)).tolist():
                    segment = x[at[f] : at[f + 1]].tobytes()
                    for g in gs:
                        out.append((rid, f, g, segment))
                        size += len(segment) // 8 + 8
                        if size >= SENT:
                            yield _rows(out)
                            out, size = [], 0
        if out:
            yield _rows(out)

    left = sets.select("_rid", "hashes").join(here, "_rid").mapInArrow(cut, "cls bigint, fragment int, g bigint, segment binary").groupBy("fragment", "g")
    right = pairs.select("a", "b", group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("fragment")).groupBy("fragment", "g")
    parts = left.cogroup(right).applyInArrow(_overlaps, "a bigint, b bigint, common bigint")
    sums = parts.groupBy("a", "b").agg(F.sum("common").alias("common"))
    return sums.join(pairs, ["a", "b"]).where((100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["cls", "fragment", "g", "segment"])


def linked(docs: DataFrame, id_col: str, text: str, *, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """(_rid, id, n, comp, rep) of every document: its row number, set size, and component: the smallest id, and the row number of the row that has it.

    Two documents link when 100 * |A and B| >= percent * |A or B|. Row numbers are those of `monotonically_increasing_id` over
    `docs` if it is read from files.
    """
    ship(docs.sparkSession)
    rows = steady(docs.select(id_col, text)).select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    # about 6 bytes a word; fragments need only be roughly even
    total = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0] // 6
    fragments = max(1, -(-total // FRAGMENT))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packs(((rid, x) for b in batches for rid, x in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), width))), fragments, np.dtype(np.uint32))

    packed = rows.select("_rid", "_text").mapInArrow(coded, PACKED_SCHEMA)
    counted = packed.groupBy("fragment").applyInArrow(lambda t: _shared(t, np.dtype(np.uint32), False), SHARED_SCHEMA)
    known = written(counted.groupBy("batch").applyInArrow(lambda t: _known(t, percent), "_rid bigint, n bigint, one bigint, two bigint, left boolean"), "signatures")
    # classes: documents with equal sets, by signature; their smallest row number stands for them
    classes = known.where("left").groupBy("n", "one", "two").agg(F.min("_rid").alias("cls"), F.count("*").alias("k"))
    classes = written(classes, "classes")
    n_classes, n_several = classes.agg(F.count("*"), F.count_if(F.col("k") > 1)).first()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, sets, size = 0, [], 0
            for x in shingle_sets(b.column(1), width):
                sets.append(x.tobytes())
                size += len(x)
                if size >= SENT or at + len(sets) == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), pa.array(sets, pa.binary())], ["_rid", "hashes"])
                    at, sets, size = at + len(sets), [], 0

    left = classes.select(F.col("cls").alias("_rid"))
    sets = written(rows.select("_rid", "_text").join(small(left, 32 * n_classes), "_rid").mapInArrow(hashed, "_rid bigint, hashes binary"), "sets")
    links = _links(sets, percent)
    several = classes.where("k > 1").select("n", "one", "two", "cls")
    of = known.join(small(several, 48 * n_several), ["n", "one", "two"], "left").select("_rid", "n", F.coalesce("cls", "_rid").alias("cls"))
    if links is not None:
        of = of.join(components(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn("cls", F.coalesce("comp", "cls")).drop("comp")
    members = written(of.join(rows.select("_rid", "_id"), "_rid"), "members")
    discard(known, classes, sets)
    best = members.groupBy("cls").agg(F.min(F.struct(F.col("_id").isNull().alias("no"), "_id", "_rid")).alias("best"))
    return members.join(best, "cls").select("_rid", F.col("_id").alias("id"), "n", F.col("best._id").alias("comp"), F.col("best._rid").alias("rep"))


def _links(sets: DataFrame, percent: int) -> DataFrame | None:
    """Verified links (a, b) between sets, enough of them to connect all that link."""
    shingles = sets.agg(F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0))).first()[0] // 8
    if not shingles:
        return None
    fragments = max(1, -(-shingles // FRAGMENT))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packs(((rid, np.frombuffer(x.as_buffer(), np.uint64)) for b in batches for rid, x in zip(b.column(0).to_pylist(), b.column(1))), fragments, np.dtype(np.uint64))

    numbers = sets.mapInArrow(whole, PACKED_SCHEMA).groupBy("fragment").applyInArrow(lambda t: _shared(t, np.dtype(np.uint64), True), SHARED_SCHEMA)
    index = written(numbers.groupBy("batch").applyInArrow(lambda t: _prefixes(t, percent), "h bigint, cls bigint, n bigint"), "prefixes")
    # entries with the same members offer the same pairs: one of them is kept
    alike = index.groupBy("h").agg(F.count("*").alias("k"), *[F.bit_xor(F.xxhash64("cls", F.lit(salt))).alias(f"x{salt}") for salt in (1, 2)]).where("k > 1")
    kept = alike.groupBy("k", "x1", "x2").agg(F.min("h").alias("h")).select("h")
    index = written(index.join(kept, "h"), "index")
    links = tested = None
    for round_, hubs in enumerate(HUBS):
        at = _open_entries(index, links)
        hub = at.groupBy("h", F.pmod(F.xxhash64("cls", F.lit(round_)), F.lit(hubs)).alias("salt")).agg(F.min(F.struct("cls", "n", "comp")).alias("hub")).select("h", "hub")
        size = (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")) & (F.col("comp") != F.col("hub.comp"))
        low = F.col("cls") < F.col("hub.cls")
        pairs = at.join(hub, "h").where(size).select(F.when(low, F.col("cls")).otherwise(F.col("hub.cls")).alias("a"), F.when(low, F.col("hub.cls")).otherwise(F.col("cls")).alias("b"), F.when(low, F.col("n")).otherwise(F.col("hub.n")).alias("na"), F.when(low, F.col("hub.n")).otherwise(F.col("n")).alias("nb"), F.col("cls").alias("by"))
        links, tested = _tried(pairs, sets, links, tested, percent)
    bounds = None
    for likeliest in (True, False):
        at = written(_open_entries(index, links), "open")
        if at.isEmpty():
            break
        if bounds is None:
            # later entries have no other sets
            bounds = written(sets.select("_rid", "hashes").join(at.select(F.col("cls").alias("_rid")).distinct(), "_rid").mapInArrow(_counted, "cls bigint, counts binary"), "bounds")
        per = at.groupBy("h", "comp").agg(F.count("*").alias("k"))
        largest = per.groupBy("h").agg(F.max(F.struct("k", "comp")).alias("most")).select("h", F.col("most.comp").alias("most"))
        probes = at.join(largest, "h").withColumn("probe", F.col("comp") != F.col("most")).join(bounds, "cls").select("h", "cls", "n", "comp", "probe", "counts")
        pairs = probes.repartition("h").sortWithinPartitions("h").mapInArrow(lambda batches, likeliest=likeliest: _probed(batches, percent, likeliest), "a bigint, b bigint, na bigint, nb bigint, by bigint")
        links, tested = _tried(pairs, sets, links, tested, percent)
        discard(at)
    discard(index, bounds)
    return links


def _tried(pairs: DataFrame, sets: DataFrame, links: DataFrame | None, tested: DataFrame | None, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The links with those among `pairs`, and the tested pairs with these."""
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.min("by").alias("by"))
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return links, tested
    new, now = written(_verified(pairs, sets, percent), "verified"), pairs.select("a", "b")
    return new if links is None else links.union(new), now if tested is None else tested.union(now)


def _with_components(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """Rows with `cls`, and the component that the links so far give it."""
    if links is None:
        return rows.withColumn("comp", F.col("cls"))
    found = written(components(links), "found").withColumnRenamed("node", "cls")
    return rows.join(found, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def _open_entries(index: DataFrame, links: DataFrame | None) -> DataFrame:
    """(h, cls, n, comp): the index's entries that hold more than one component."""
    at = _with_components(index, links)
    several = at.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("h")
    return at.join(several, "h")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of each set are in each of `NARROW` fragments, 255 at most."""
    for batch in batches:
        sets = (np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1))
        counts = [np.minimum(np.diff(_cuts(x, NARROW)), 255).astype(np.uint8).tobytes() for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.binary())], ["cls", "counts"])


def _probed(batches: Iterator[pa.RecordBatch], percent: int, likeliest: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, by): the pairs of entries, which come one after the other, that may link; likeliest: a probe's likeliest of each component only."""
    kinds = {"h": np.int64, "cls": np.int64, "n": np.int64, "comp": np.int64, "probe": bool}
    rest: dict[str, np.ndarray] = {}
    for batch in _then_none(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = {c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False), k) for c, k in kinds.items()}
            new["counts"] = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("counts")), np.uint8).reshape(-1, NARROW)
            rest = {c: np.concatenate([rest[c], x]) for c, x in new.items()} if rest else new
        if not rest:
            return
        edge = np.flatnonzero(np.concatenate([[True], rest["h"][1:] != rest["h"][:-1], [True]]))
        # the last entry may go on in the next batch
        ends = edge if batch is None else edge[:-1]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield from _entry(*(rest[c][a:b] for c in ("cls", "n", "comp", "probe", "counts")), percent, likeliest)
        rest = {c: x[ends[-1] :].copy() for c, x in rest.items()}


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _entry(cls: np.ndarray, n: np.ndarray, comp: np.ndarray, probe: np.ndarray, counts: np.ndarray, percent: int, likeliest: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of one entry that may link, a batch for some probes."""
    over = n - counts.sum(axis=1, dtype=np.int64)  # what the counts left out at 255
    mine, other, size = [], [], 0
    for i in np.flatnonzero(probe).tolist():
        # two probes meet once
        at = np.flatnonzero((comp != comp[i]) & (~probe | (cls < cls[i])) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        bound = np.concatenate([np.minimum(counts[at[k : k + SENT // NARROW]], counts[i]).sum(axis=1, dtype=np.int64) for k in range(0, len(at), SENT // NARROW)]) if len(at) else at
        bound += np.minimum(over[at], over[i])
        may = (100 + percent) * bound >= percent * (n[at] + n[i])
        at, bound = at[may], bound[may]
        if likeliest and len(at) > 1:
            at = at[np.lexsort((cls[at], n[at] + n[i] - 2 * bound, comp[at]))]
            at = at[np.concatenate([[True], comp[at][1:] != comp[at][:-1]])]
        mine.append(np.full(len(at), i))
        other.append(at)
        size += len(at)
        if size >= SENT:
            yield _as_pairs(cls, n, mine, other)
            mine, other, size = [], [], 0
    if size:
        yield _as_pairs(cls, n, mine, other)


def _as_pairs(cls: np.ndarray, n: np.ndarray, mine: list[np.ndarray], other: list[np.ndarray]) -> pa.RecordBatch:
    i, j = np.concatenate(mine), np.concatenate(other)
    a, b = np.where(cls[i] < cls[j], i, j), np.where(cls[i] < cls[j], j, i)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (cls[a], cls[b], n[a], n[b], cls[i])], ["a", "b", "na", "nb", "by"])
