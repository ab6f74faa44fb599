"""A store of keys: append-only deltas, sorted runs and manifests, all Parquet and JSON in one folder.

Every mutation is one Spark write and one manifest commit; it is visible once that commit is. Readers
pin a manifest version, whose files never change. Results don't depend on flushes, compactions or reopening.

Sequence numbers follow the order of commits: a delta's rows hold offsets, and the commit that publishes it gives
the base they are added to, just above all that is committed by then. So a writer that comes late is newer than
whatever was compacted meanwhile, and a batch uses up only the numbers its rows span.
"""

from __future__ import annotations

import logging
import re
import threading
from collections.abc import Callable, Iterable
from copy import deepcopy
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keytide.functions.keys import in_range, next_prefix
from keytide.operators import search, stats as statistics, trigrams
from keytide.operators.newest import live, newest_wins, visible
from keytide.plans import compaction
from keytide.plans.pattern import Analysis, analyze
from keytide.schema import DELETE, INSERT, LOG, MAX_KEY_BYTES, MAX_TTL_NANOS, CorruptStore, EmptyKey, InvalidTTL, KeyTooLarge, ReadOnlyStore, StalePlan, StoreClosed
from keytide.sources.manifest import Manifest, ManifestLog, Segment, now
from keytide.sources.meter import SCHEMA as ACTIVITY, Meter

#: Options that change behaviour, with defaults.
OPTIONS = {
    "default_ttl": 0,
    "memtable_target_bytes": 512 << 20,
    "memtable_max_deltas": 64,
    "auto_flush": True,
    "background_compaction": False,
    "max_l0": compaction.MAX_L0,
    "prefix_bloom_fpr": 0.01,
    "enable_trigrams": True,
    "range_partitions": 0,
    "run_bytes": 512 << 20,
    "run_memory": 256 << 20,
    "verify_on_open": False,
    "retain_seconds": 30,
    "cache_label_advance_bytes": 32 << 20,
    "cache_nfa_transition_bytes": 32 << 20,
    "autotuner_enabled": False,
}
#: Accepted for compatibility; Spark decides these.
HINTS = {"parallelism", "cache_policy", "filter_threshold", "compaction_priority", "mmap_cache_size", "wal_buffer_size", "async_filter_build", "logger"}
#: Rows of a partition of one batch.
ROW_BITS = 28
MAX_SEQ = (1 << 63) - 1
#: The last parts of a file's path: a delta is a folder, a run has an entry for each file.
_PLACE = r"(delta/[0-9]+|segments/[0-9]+/[^/]+)(/[^/]*)?$"


def _place() -> Column:
    return F.regexp_extract("_metadata.file_path", _PLACE, 1)


def _extents(rows: DataFrame) -> DataFrame:
    """(path, n, low, high, gone, least, most, key_bytes) of each place that rows of the log are read from."""
    key = (statistics.least("key").alias("low"), statistics.greatest("key").alias("high"), F.sum(F.octet_length("key")).alias("key_bytes"))
    return rows.groupBy(_place().alias("path")).agg(F.count("*").alias("n"), *key, F.count_if(F.col("op") == DELETE).alias("gone"), F.min("seq").alias("least"), F.max("seq").alias("most"))


def _causes(e: Exception) -> str:
    """The messages of an exception of Spark and of whatever caused it."""
    out, cause = [str(e)], getattr(e, "_origin", None)
    while cause is not None:
        out.append(str(cause.getMessage()))
        cause = cause.getCause()
    return "\n".join(out)


class Store:
    def __init__(self, spark: SparkSession, path: str, read_only: bool, version: int | None, options: dict) -> None:
        unknown = set(options) - set(OPTIONS) - HINTS
        if unknown:
            raise TypeError(f"unknown options: {sorted(unknown)}")
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only or version is not None
        self.options = OPTIONS | {k: v for k, v in options.items() if k in OPTIONS}
        self.log = options.get("logger") or logging.getLogger("keytide")
        self.manifests = ManifestLog(spark, self.path)
        self._pinned = self.manifests.load(version) if self.read_only else None
        self._closed, self._paused = False, 0
        self.meter = Meter()
        self._worker: threading.Thread | None = None
        self._wake, self._stop, self._idle = threading.Event(), threading.Event(), threading.Event()
        self._idle.set()
        self.options |= self.manifest().tuning
        if self.options["verify_on_open"] and (bad := self.verify().where("not ok").limit(1).collect()):
            raise CorruptStore(bad[0].problem)

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, read_only: bool = False, version: int | None = None, **options: object) -> Store:
        """Opens or makes a store. read_only, or a manifest version, pins what is committed now."""
        return cls(spark, path, read_only, version, options)

    # state

    def manifest(self) -> Manifest:
        return self._pinned or self.manifests.load()

    def _usable(self, writing: bool = False) -> None:
        if self._closed:
            raise StoreClosed(self.path)
        if writing and self.read_only:
            raise ReadOnlyStore(self.path)

    def _commit(self, change: Callable[[Manifest], None]) -> Manifest:
        """Applies a change to the newest manifest, again if another writer came first."""
        while True:
            new = deepcopy(self.manifests.load())
            change(new)
            if self.manifests.commit(new):
                return new

    # writing

    def _keys(self, keys: DataFrame | Iterable[bytes | str]) -> DataFrame:
        if isinstance(keys, DataFrame):
            return keys.select(F.col("key").cast("binary").alias("key"))
        rows = [(k.encode() if isinstance(k, str) else bytes(k),) for k in keys]
        return self.spark.createDataFrame(rows, "key binary").coalesce(1)

    def _append(self, rows: DataFrame, token: str | None = None, mark: tuple[str, int] | None = None, op: str = "insert") -> int:
        """Writes rows (key, op, expires_at[, seq]) as a delta in one pass, which also checks them."""
        self._usable(writing=True)

        def applied(m: Manifest) -> bool:
            return token is not None and token in m.tokens or mark is not None and m.marks.get(mark[0], -1) >= mark[1]

        if applied(self.manifest()):
            return 0
        with self.meter.timed(op):
            own = self._new_id()
            name = f"delta/{own}"
            size = F.coalesce(F.octet_length("key"), F.lit(0))
            key = F.when(size.between(1, MAX_KEY_BYTES), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("keytide: a key of "), size.cast("string"), F.lit(" bytes"))).cast("binary"))
            if "seq" in rows.columns:
                offset = F.col("seq").cast("long")
                fits = offset.isNotNull() & (offset >= 0)
            else:
                where = F.monotonically_increasing_id()
                part, row = F.shiftright(where, 33), where.bitwiseAND(F.lit((1 << 33) - 1))
                offset, fits = F.shiftleft(part, ROW_BITS) + row, row < 1 << ROW_BITS
            seq = F.when(fits, offset).otherwise(F.raise_error(F.lit("a sequence number is null or negative, or a partition has too many rows")).cast("long"))
            out = rows.select(key.alias("key"), F.col("op").cast("byte").alias("op"), seq.alias("seq"), F.col("expires_at").cast("long").alias("expires_at"), F.lit(own).cast("long").alias("_slot"))
            try:
                out.write.parquet(f"{self.path}/{name}")
                entry = self._entries(name, -1, own)
            except Exception as e:
                self._drop(name)
                if found := re.search(r"keytide: a key of (\d+) bytes", _causes(e)):
                    n = int(found[1])
                    raise (KeyTooLarge(f"a key has {n} bytes, the limit is {MAX_KEY_BYTES}") if n else EmptyKey("a key is empty or null")) from None
                raise
            if not entry:
                self._drop(name)
                return 0
            (segment, least, most), = entry

            def add(m: Manifest) -> None:
                if applied(m):
                    m.removed.append([name, now()])
                    return
                # numbers that are above all others stay as their source gave them
                base = 0 if least >= m.next_seq and most < MAX_SEQ >> 1 else m.next_seq - least
                if base + most >= MAX_SEQ:
                    raise OverflowError("out of sequence numbers")
                segment.base, m.next_seq = base, base + most + 1
                m.segments.append(segment)
                if token is not None:
                    m.tokens.append(token)
                if mark is not None:
                    m.marks[mark[0]] = mark[1]

            m = self._commit(add)
        self.meter.rows[op] += segment.num_keys
        deltas = m.deltas()
        if self.options["auto_flush"] and (sum(s.bytes for s in deltas) >= self.options["memtable_target_bytes"] or len(deltas) >= self.options["memtable_max_deltas"]):
            try:
                self.flush()
            except StalePlan:  # another writer flushed the same deltas
                self.log.info("flush of %s left to another writer", self.path)
        return segment.num_keys

    def _drop(self, name: str) -> None:
        self.manifests.fs.delete(self.manifests.path(name), True)

    def _entries(self, name: str, level: int, run: int) -> list[tuple[Segment, int, int]]:
        """(entry, least seq, greatest seq) of a delta's folder, or of each file of a run's folder: one row a file is gathered."""
        found = _extents(self.spark.read.schema(LOG).parquet(f"{self.path}/{name}"))
        size = lambda path: self.manifests.fs.getContentSummary(self.manifests.path(path)).getLength()
        return [(Segment(run, level, r.path, bytes(r.low).hex(), bytes(r.high).hex(), size(r.path), r.n, r.gone, now(), run=run, key_bytes=r.key_bytes), r.least, r.most) for r in found.collect()]

    def insert_many(self, keys: DataFrame | Iterable[bytes | str], ttl: int | None = None, as_of: int | None = None) -> int:
        """Inserts keys (a DataFrame with `key`, or an iterable); ttl in nanoseconds, 0 = never."""
        ttl = self.options["default_ttl"] if ttl is None else ttl
        if not 0 <= ttl <= MAX_TTL_NANOS:
            raise InvalidTTL(str(ttl))
        at = (now() if as_of is None else as_of) + ttl if ttl else 0
        self._usable(writing=True)
        return self._append(self._keys(keys).select("key", F.lit(INSERT).alias("op"), F.lit(at).cast("long").alias("expires_at")))

    def insert(self, key: bytes | str, ttl: int | None = None) -> int:
        return self.insert_many([key], ttl)

    def delete_many(self, keys: DataFrame | Iterable[bytes | str]) -> int:
        """Deletes keys, whether they exist or not."""
        self._usable(writing=True)
        return self._append(self._keys(keys).select("key", F.lit(DELETE).alias("op"), F.lit(0).cast("long").alias("expires_at")), op="delete")

    def delete(self, key: bytes | str) -> int:
        return self.delete_many([key])

    def apply(self, log: DataFrame, token: str | None = None, mark: tuple[str, int] | None = None) -> int:
        """Appends rows (key, op, seq, expires_at) as one batch; seq orders them within it.

        A token that was applied is skipped; all tokens are kept. A mark (stream, number) is skipped unless it is
        above the stream's last one, which takes one entry a stream.
        """
        return self._append(log.select(F.col("key").cast("binary").alias("key"), "op", "expires_at", "seq"), token, mark, op="apply")

    def vacuum_prefix(self, prefix: bytes, as_of: int | None = None) -> int:
        """Deletes every live key with the prefix."""
        self._usable(writing=True)
        low, high = prefix or None, next_prefix(prefix)
        rows = self._live(self._segments(low, high), as_of, lambda rows: rows.where(in_range(F.col("key"), low, high)))
        return self._append(rows.select("key", F.lit(DELETE).alias("op"), F.lit(0).cast("long").alias("expires_at")), op="delete")

    # reading

    def _segments(self, low: bytes | None = None, high: bytes | None = None, manifest: Manifest | None = None) -> list[Segment]:
        return [s for s in (manifest or self.manifest()).segments if s.overlaps(low, high)]

    def _read(self, segments: list[Segment], **options: str) -> DataFrame:
        """The rows of segments with their sequence numbers; one scan of runs and one of deltas."""
        read = lambda some, schema: self.spark.read.options(**options).schema(schema).parquet(*[f"{self.path}/{s.path}" for s in some])
        runs, deltas = [s for s in segments if s.level >= 0], [s for s in segments if s.level < 0]
        parts = [read(runs, LOG)] if runs else []
        if deltas:
            first = min(s.id for s in deltas)
            bases: list[int | None] = [None] * (max(s.id for s in deltas) - first + 1)
            for s in deltas:
                bases[s.id - first] = s.base
            base = F.get(F.lit(bases) if None not in bases else F.array(*[F.lit(b).cast("long") for b in bases]), (F.col("_slot") - first).cast("int")).cast("long")
            parts.append(read(deltas, StructType([*LOG.fields, StructField("_slot", LongType())])).withColumn("seq", F.col("seq") + base).select(*LOG.names))
        if not parts:
            return self.spark.createDataFrame([], LOG)
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])

    def _live(self, segments: list[Segment], as_of: int | None = None, pick: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """Live rows; `pick` filters by the key alone, below newest-wins. Only files whose ranges overlap are shuffled."""
        at = now() if as_of is None else as_of
        alone, mixed = compaction.apart(segments)
        parts = [live(pick(self._read(some)), at, unique) for some, unique in ((alone, True), (mixed, False)) if some]
        if not parts:
            return self.spark.createDataFrame([], LOG)
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])

    def _log(self, low: bytes | None = None, high: bytes | None = None, manifest: Manifest | None = None) -> DataFrame:
        return self._read(self._segments(low, high, manifest)).where(in_range(F.col("key"), low, high))

    def log_rows(self) -> DataFrame:
        """All rows of the log, shadowed ones included."""
        self._usable()
        return self._log()

    def _pruned(self, analysis: Analysis) -> list[Segment]:
        m = self.manifest()
        ranges = analysis.ranges()
        segments = [s for s in m.segments if not ranges or any(s.overlaps(a, b) for a, b in ranges)]
        indexed = [s for s in segments if s.trigrams]
        # the index covers deletes too, so a run without the literals has no row of any key that matches
        if analysis.literals and indexed:
            parts = self.spark.read.parquet(*[f"{self.path}/{p}" for p in sorted({s.trigrams for s in indexed})])
            having = {r.segment_id for r in trigrams.segments_with(parts, analysis.literals).collect()}
            segments = [s for s in segments if not s.trigrams or s.id in having]
        return segments

    def live(self, as_of: int | None = None) -> DataFrame:
        self._usable()
        return self._live(self._segments(), as_of)

    def regex_search(self, pattern: str | None, *, match: str = "search", mode: str = "strings", limit: int = 0, order: str | None = None, as_of: int | None = None) -> DataFrame:
        """Live keys that match; None matches all. `meter` counts the call and the time to plan it; `results` times the run."""
        self._usable()
        with self.meter.timed("search"):
            pattern = "" if pattern is None else pattern
            segments = self._pruned(analyze(pattern, match))
            return search.shaped(self._live(segments, as_of, lambda rows: search.where_pattern(rows, pattern, match)), mode, limit, order)

    def range_scan(self, start: bytes | None = None, end: bytes | None = None, *, as_of: int | None = None, **shape: object) -> DataFrame:
        self._usable()
        with self.meter.timed("range"):
            low, high = start or None, end or None
            return search.shaped(self._live(self._segments(low, high), as_of, lambda rows: rows.where(in_range(F.col("key"), low, high))), **shape)

    def results(self, found: DataFrame) -> list:
        """The rows of a search on the driver, with the run's latency in `activity`."""
        with self.meter.timed("results"):
            rows = found.collect()
        self.meter.rows["results"] += len(rows)
        return rows

    def prefix_scan(self, prefix: bytes, **query: object) -> DataFrame:
        return self.range_scan(prefix, next_prefix(prefix), **query)

    def multi_search(self, patterns: list[str], *, match: str = "search", as_of: int | None = None) -> DataFrame:
        self._usable()
        at = now() if as_of is None else as_of
        with self.meter.timed("multi_search"):
            alone, mixed = compaction.apart(self._segments())
            parts = [search.multi_search(self._read(some), patterns, at, match=match, unique=unique) for some, unique in ((alone, True), (mixed, False)) if some]
            if not parts:
                return search.multi_search(self._read([]), patterns, at, match=match, unique=True)
            return parts[0] if len(parts) == 1 else parts[0].union(parts[1])

    def get(self, key: bytes, as_of: int | None = None) -> bool:
        """Whether a key is live."""
        return not self.range_scan(key, key + b"\x00", as_of=as_of).isEmpty()

    # maintenance

    def _write_run(self, rows: DataFrame, own: int, level: int, inputs: list[Segment]) -> list[Segment]:
        """One file, and one entry, a range of keys; neither a file nor the sort that makes it outgrows its limit: files say little of memory, as short keys compress well."""
        name = f"segments/{own}"
        needed = [-(-sum(s.bytes for s in inputs) // self.options["run_bytes"]), -(-sum(s.memory for s in inputs) // self.options["run_memory"])]
        parts = self.options["range_partitions"] or max(1, *needed)
        sorted_ = rows.repartitionByRange(parts, "key").sortWithinPartitions("key")
        sorted_.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.fpp#key", str(self.options["prefix_bloom_fpr"])).parquet(f"{self.path}/{name}")
        return [s for s, _, _ in self._entries(name, level, own)]

    def _new_id(self) -> int:
        return self._commit(lambda m: setattr(m, "next_id", m.next_id + 1)).next_id - 1

    def _replace(self, gone: set[int], made: list[Segment], run: int, note: dict) -> None:
        def change(m: Manifest) -> None:
            active = {s.id for s in m.segments}
            if not gone <= active:
                raise StalePlan(f"no longer active: {sorted(gone - active)}")
            for k, s in enumerate(made):
                s.id = m.next_id + k
            m.next_id += len(made)
            kept = [s for s in m.segments if s.id not in gone] + made
            indexes = {s.trigrams for s in m.segments if s.id in gone} - {s.trigrams for s in kept} - {""}
            m.removed += [[p, now()] for p in [s.path for s in m.segments if s.id in gone] + sorted(indexes)]
            m.segments = kept
            m.history = [*m.history, note | {"at": now()}][-1000:]

        try:
            self._commit(change)
        except StalePlan:
            self._drop(f"segments/{run}")
            raise
        self.log.info("%s: %s replaced by %d files", self.path, note, len(made))

    def flush(self) -> bool:
        """Merges all deltas into one sorted run of level 0; deletes and expired rows stay, as older runs may need them."""
        self._usable(writing=True)
        deltas = self.manifest().deltas()
        if not deltas:
            return False
        with self.meter.timed("flush"):
            own = self._new_id()
            run = self._write_run(newest_wins(self._read(deltas)), own, 0, deltas)
            self._replace({s.id for s in deltas}, run, own, {"flush": own, "inputs": [s.id for s in deltas]})
        if self._worker is not None:
            self._wake.set()
        elif self.options["background_compaction"] and not self._paused:
            self.compact(force=False)
        return True

    def compact(self, as_of: int | None = None, force: bool = True) -> bool:
        """Runs planned compactions: one if forced, else as many as the levels ask for."""
        self._usable(writing=True)
        at, done = now() if as_of is None else as_of, False
        while plan := compaction.plan(self.manifest().runs(), force and not done, self.options["max_l0"]):
            with self.meter.timed("compact"):
                inputs = [s for s in self.manifest().runs() if s.id in plan.inputs]
                rows = newest_wins(self._read(inputs))
                # deltas, and whatever is still to be committed, are newer than any run: they never need what is dropped here
                if plan.bottom:
                    rows = rows.where(visible(at))
                own = self._new_id()
                run = self._write_run(rows, own, plan.target, inputs)
                self._replace(set(plan.inputs), run, own, {"compaction": own, "inputs": list(plan.inputs), "target": plan.target})
            done = True
        return done

    # background work

    def start_compaction(self, interval: float = 10.0) -> None:
        """Starts the store's own thread: compactions the levels ask for, and tuning where it is switched on."""
        self._usable(writing=True)
        if self._worker is None:
            self._stop.clear()
            self._worker = threading.Thread(target=self._work, args=(interval,), name="keytide-compaction", daemon=True)
            self._worker.start()

    def trigger_compaction(self) -> None:
        """Lets the thread look now instead of at its next interval; without a thread, looks here."""
        if self._worker is None:
            self.compact(force=False)
            return
        self._idle.clear()
        self._wake.set()

    def stop_compaction(self) -> None:
        """Ends the thread, after what it is at."""
        if self._worker is not None:
            self._stop.set()
            self._wake.set()
            self._worker.join()
            self._worker = None
        self._idle.set()

    def wait_idle(self, timeout: float | None = None) -> bool:
        """Waits until a triggered look is done; False if the time is over first."""
        return self._idle.wait(timeout)

    def _work(self, interval: float) -> None:
        while not self._stop.is_set():
            self._wake.wait(interval)
            self._wake.clear()
            if not self._stop.is_set():
                try:
                    if not self._paused:
                        self.compact(force=False)
                    if self.options["autotuner_enabled"]:
                        self.autotune()
                except StalePlan:
                    self.log.info("%s: another writer compacted first", self.path)
                except Exception:  # the thread lives on, the next look tries again
                    self.log.exception("%s: background work failed", self.path)
            if not self._wake.is_set():
                self._idle.set()

    def set_autotuner_enabled(self, enabled: bool) -> None:
        self.tune(autotuner_enabled=enabled)

    def pause_compaction(self) -> None:
        self._paused += 1

    def resume_compaction(self) -> None:
        self._paused = max(0, self._paused - 1)

    def vacuum(self, retain_seconds: int | None = None) -> int:
        """Deletes files that were replaced at least `retain_seconds` ago; pinned older versions lose them."""
        self._usable(writing=True)
        retain = self.options["retain_seconds"] if retain_seconds is None else retain_seconds
        limit = now() - retain * 10**9
        due = [p for p, at in self.manifest().removed if at <= limit]
        return self._forget(due)

    def prune_deltas(self) -> int:
        """Deletes the folders of deltas that a flush replaced, at once; older pinned versions lose them."""
        self._usable(writing=True)
        return self._forget([p for p, _ in self.manifest().removed if p.startswith("delta/")])

    def _forget(self, due: list[str]) -> int:
        gone = set(due)
        m = self._commit(lambda m: setattr(m, "removed", [r for r in m.removed if r[0] not in gone]))
        for p in due:
            self._drop(p)
        # a run's folder goes with its last file
        held = {p.rpartition("/")[0] for p in [s.path for s in m.segments] + [p for p, _ in m.removed]}
        for folder in {p.rpartition("/")[0] for p in due if p.startswith("segments/")} - held:
            self._drop(folder)
        return len(due)

    def repair(self) -> list[str]:
        """Folders that no manifest entry names. They are reported and never adopted: they may be compacted-away rows."""
        self._usable()
        m = self.manifest()
        paths = [s.path for s in m.segments] + [s.trigrams for s in m.segments] + [p for p, _ in m.removed] + [q["path"] for q in m.quarantined]
        known = {"/".join(p.split("/")[:2]) for p in paths}
        out = []
        for top in ("delta", "segments", "trigrams"):
            if self.manifests.fs.exists(self.manifests.path(top)):
                out += [f"{top}/{s.getPath().getName()}" for s in self.manifests.fs.listStatus(self.manifests.path(top))]
        return sorted(p for p in out if p not in known)

    def verify(self) -> DataFrame:
        """(id, ok, problem): whether each segment can be read and holds what its entry says; one job for all, a row a segment gathered."""
        self._usable()
        segments = self.manifest().segments
        found = {}
        if segments:
            # a file that can't be read gives no rows, so its segment differs from its entry
            rows = self.spark.read.options(ignoreCorruptFiles="true", ignoreMissingFiles="true").schema(LOG)
            there = [s for s in segments if self.manifests.fs.exists(self.manifests.path(s.path))]
            if there:
                per = _extents(rows.parquet(*[f"{self.path}/{s.path}" for s in there]))
                found = {r.path: (r.n, r.gone, bytes(r.low).hex(), bytes(r.high).hex()) for r in per.collect()}
        ok = {s.id: found.get(s.path) == (s.num_keys, s.num_tombstones, s.min_key, s.max_key) for s in segments}
        return self.spark.createDataFrame([(i, good, "" if good else f"segment {i} can't be read or differs from its entry") for i, good in ok.items()], "id bigint, ok boolean, problem string")

    def quarantine(self) -> list[str]:
        """Takes segments that fail `verify` out of the store, so that reads go on without them; their files stay for repair by hand."""
        self._usable(writing=True)
        bad = {r.id for r in self.verify().where("not ok").collect()}

        def change(m: Manifest) -> None:
            m.quarantined += [asdict(s) | {"quarantined": now()} for s in m.segments if s.id in bad]
            m.segments = [s for s in m.segments if s.id not in bad]

        if bad:
            before = {s.id: s.path for s in self.manifest().segments}
            self._commit(change)
            for i in sorted(bad):
                self.log.warning("%s: quarantined %s", self.path, before.get(i))
        return [before[i] for i in sorted(bad) if i in before] if bad else []

    def build_trigram_index(self) -> int:
        """Builds the missing trigram indexes of runs' files in one job; searches with required literals skip files by them."""
        self._usable(writing=True)
        missing = [s for s in self.manifest().runs() if not s.trigrams]
        if not self.options["enable_trigrams"] or not missing:
            return 0
        path = f"trigrams/{self._new_id()}"
        # one row a file of the manifest
        names = F.broadcast(self.spark.createDataFrame([(s.path, s.id) for s in missing], "_path string, segment_id bigint"))
        keys = self.spark.read.schema(LOG).parquet(*[f"{self.path}/{s.path}" for s in missing]).select("key", _place().alias("_path")).join(names, "_path")
        trigrams.segment_index(keys).write.parquet(f"{self.path}/{path}")
        ids = {s.id for s in missing}
        self._commit(lambda m: [setattr(s, "trigrams", path) for s in m.segments if s.id in ids])
        return len(missing)

    def stats(self) -> DataFrame:
        """(level, segments, bytes, num_keys, tombstone_fraction); level -1 are deltas."""
        self._usable()
        return statistics.level_stats(self.manifests.frame(self.manifest()))

    def activity(self) -> DataFrame:
        """(op, calls, failures, rows, per_second, p50_ms, p95_ms, p99_ms) of this handle since it was opened."""
        return self.spark.createDataFrame(self.meter.table(), ACTIVITY)

    def disk_usage(self) -> DataFrame:
        """(category, files, bytes): deltas, segments, trigrams, manifest; replaced files that aren't vacuumed count too."""
        self._usable()
        out = []
        for category in ("delta", "segments", "trigrams", "manifest"):
            where = self.manifests.path(category)
            if self.manifests.fs.exists(where):
                total = self.manifests.fs.getContentSummary(where)
                out.append((category, total.getFileCount(), total.getLength()))
        return self.spark.createDataFrame(out, "category string, files bigint, bytes bigint")

    def tune(self, **values: int) -> dict[str, int]:
        """Changes options and keeps the change in the manifest."""
        self._usable(writing=True)
        unknown = set(values) - set(OPTIONS)
        if unknown:
            raise TypeError(f"unknown options: {sorted(unknown)}")
        self.options |= values
        self._commit(lambda m: m.tuning.update(values))
        return dict(self.options)

    def autotune(self, **observed: float) -> dict[str, int]:
        """Tunes by what was observed; what isn't given comes from `activity`."""
        calls = self.meter.calls
        writes, queries = ("insert", "delete", "apply"), ("search", "range", "multi_search")
        own = {
            "writes_per_second": sum(calls[op] for op in writes) / self.meter.seconds(),
            "queries_per_second": sum(calls[op] for op in queries) / self.meter.seconds(),
            "p99_ms": self.meter.percentile("results", 99),
        }
        names = ("memtable_target_bytes", "cache_label_advance_bytes", "cache_nfa_transition_bytes")
        old = {k: self.options[k] for k in names}
        changed = {k: v for k, v in statistics.autotune(own | observed, old).items() if v != old[k]}
        return self.tune(**changed) if changed else dict(self.options)

    def close(self) -> None:
        """Flushes and closes; a second call does nothing."""
        if not self._closed:
            self.stop_compaction()
            if not self.read_only:
                self.flush()
            self._closed = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


