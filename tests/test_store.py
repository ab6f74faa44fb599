from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from keytide.operators import stats, trigrams
from keytide.plans.compaction import plan
from keytide.schema import EmptyKey, InvalidTTL, KeyTooLarge, ReadOnlyStore, StoreClosed
from keytide.sources.manifest import Segment
from keytide.sources.store import Store
from keytide.streaming.live import ingest

#: Keys, patterns and what they must find in the RE2 dialect.
KEYS = [
    "apple", "application", "apply", "banana", "bandana", "cat", "catalog", "dog", "doggy", "test123", "test456", "test789", "abc123def", "xyz789",
    "hello-world", "hello_world", "hello.world", "hello@world", "Test", "TEST", "TeSt", "café", "naïve", "日本語",
    "very-long-key-with-multiple-segments-separated-by-dashes", "another_long_key_with_underscores_instead_of_dashes", "a", "z", "aaa", "zzz",
]
GOLDEN = {
    "^app.*": ["apple", "application", "apply"],
    ".*log$": ["catalog"],
    "^cat$": ["cat"],
    "^test[0-9]+$": ["test123", "test456", "test789"],
    "^(dog|cat)$": ["cat", "dog"],
    "^hello.world$": ["hello-world", "hello.world", "hello@world", "hello_world"],
    "^dog(gy)?$": ["dog", "doggy"],
    "^a+$": ["a", "aaa"],
    "^z*$": ["z", "zzz"],
    "^test[0-9]{3}$": ["test123", "test456", "test789"],
    "^[a-z]{3,5}$": ["aaa", "apple", "apply", "cat", "dog", "doggy", "zzz"],
    "^[^0-9]+$": [k for k in KEYS if not any(c.isdigit() for c in k)],
    "^café$": ["café"],
    "^Test$": ["Test"],
    "^[a-z]+[0-9]+[a-z]+$": ["abc123def"],
    "^[a-z]+-[a-z]+$": ["hello-world"],
    "^[a-z]+_[a-z]+$": ["hello_world"],
    "^(test|xyz)[0-9]{3}(def)?$": ["test123", "test456", "test789", "xyz789"],
    ".*": KEYS,
}


def keys(df) -> list[str]:
    return sorted(bytes(r.key).decode() for r in df.select("key").collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store.open(spark, f"file://{tmp_path}/store")


def test_golden_table_before_and_after_flush_and_compaction(store):
    store.insert_many(KEYS[:12])
    store.insert_many(KEYS[12:])
    for step in (lambda: None, store.flush, store.compact):
        step()
        found = store.multi_search(list(GOLDEN)).groupBy("pattern").agg(F.collect_list("key").alias("k"))
        got = {r.pattern: sorted(bytes(k).decode() for k in r.k) for r in found.collect()}
        assert got == {p: sorted(e) for p, e in GOLDEN.items()}


def test_any_interleaving_equals_a_dictionary(spark, tmp_path):
    rng = random.Random(5)
    store, model, clock = Store.open(spark, f"file://{tmp_path}/model", max_l0=2), {}, 1000
    names = [f"k{i}" for i in range(12)]
    for step in range(14):
        clock += 10
        some = rng.sample(names, 5)
        act = rng.choice(["insert", "ttl", "delete", "flush", "compact", "reopen"]) if step else "insert"
        if act == "insert":
            store.insert_many(some)
            model.update(dict.fromkeys(some, 0))
        elif act == "ttl":
            store.insert_many(some, ttl=25, as_of=clock)
            model.update(dict.fromkeys(some, clock + 25))
        elif act == "delete":
            store.delete_many(some)
            for k in some:
                model.pop(k, None)
        elif act == "flush":
            store.flush()
        elif act == "compact":
            store.compact(as_of=clock)
        else:
            store.close()
            store = Store.open(spark, store.path, max_l0=2)
        want = sorted(k for k, e in model.items() if not e or e > clock)
        assert keys(store.live(as_of=clock)) == want, (step, act)
        assert keys(store.prefix_scan(b"k1", as_of=clock)) == [k for k in want if k.startswith("k1")]


def test_lifecycle(spark, store):
    store.insert_many(["foo", "bar"])
    store.delete("foo")
    store.flush()
    store.insert("foo")
    assert keys(store.regex_search("^foo$")) == ["foo"] and store.get(b"foo") and not store.get(b"fo")
    reader = Store.open(spark, store.path, read_only=True)
    store.delete_many(["foo"])
    assert keys(reader.live()) == ["bar", "foo"] and keys(store.live()) == ["bar"]
    with pytest.raises(ReadOnlyStore):
        reader.insert("x")
    for bad, error in (([""], EmptyKey), (["x" * (1 << 20) + "y"], KeyTooLarge)):
        with pytest.raises(error):
            store.insert_many(bad)
    with pytest.raises(InvalidTTL):
        store.insert_many(["x"], ttl=-1)
    assert store.vacuum_prefix(b"ba") == 1 and keys(store.live()) == []
    store.flush()
    assert store.verify().where("not ok").count() == 0 and store.repair() == []
    store.compact()
    assert [tuple(r)[:2] for r in store.stats().select("level", "segments").collect()] == []
    assert store.vacuum(0) > 0
    store.tune(max_l0=3)
    assert Store.open(spark, store.path).options["max_l0"] == 3
    with pytest.raises(TypeError):
        store.tune(nope=1)
    store.close()
    store.close()
    with pytest.raises(StoreClosed):
        store.insert("x")


def test_a_replayed_micro_batch_changes_nothing(spark, store, tmp_path):
    log = spark.createDataFrame([(b"a", 1, 1, 0), (b"b", 1, 2, 0), (b"a", 2, 3, 0)], "key binary, op tinyint, seq bigint, expires_at bigint")
    source = str(tmp_path / "in")
    log.write.parquet(source)
    stream = spark.readStream.schema(log.schema).parquet(source)
    ingest(stream, store, str(tmp_path / "c1"), "q").awaitTermination()
    ingest(stream, store, str(tmp_path / "c2"), "q").awaitTermination()  # as after a lost checkpoint
    assert keys(store.live()) == ["b"] and store.log_rows().count() == 3


def test_trigram_index_skips_runs(store):
    store.insert_many(["xxabcxx"])
    store.flush()
    store.insert_many(["other"])
    store.flush()
    assert store.build_trigram_index() == 2 and store.build_trigram_index() == 0
    assert keys(store.regex_search("abc")) == ["xxabcxx"] and keys(store.regex_search("ab.x|q")) == ["xxabcxx"]


def test_pause_is_counted_and_shapes_are_checked(store):
    store.pause_compaction()
    store.pause_compaction()
    store.resume_compaction()
    assert store._paused == 1
    store.insert_many([f"test{i}" for i in range(10)])
    assert store.regex_search("test", limit=3).count() == 3 and store.regex_search("test", mode="count").first().n == 10
    assert keys(store.range_scan(b"test2", b"test5")) == ["test2", "test3", "test4"] and keys(store.regex_search(None, limit=2, order="key")) == ["test0", "test1"]
    assert store.regex_search(None, mode="ids").distinct().count() == 10
    with pytest.raises(ValueError):
        store.regex_search("x", mode="nope")


def segment(i: int, level: int, low: str, high: str, size: int = 1) -> Segment:
    return Segment(i, level, "", low.encode().hex(), high.encode().hex(), size, 1, 0, i)


def test_compaction_plans():
    assert plan([segment(i, 0, "a", "b") for i in range(7)]) is None
    full = plan([segment(i, 0, "a", "b") for i in range(8)] + [segment(20, 1, "b", "c"), segment(21, 1, "x", "z"), segment(22, 2, "c", "d")])
    assert full.inputs == (*range(8), 20) and full.target == 1 and not full.bottom
    assert plan([segment(1, 0, "a", "b"), segment(2, 1, "x", "z")], force=True).bottom
    big = plan([segment(1, 1, "a", "c", 6 << 30), segment(2, 2, "b", "d"), segment(3, 2, "x", "y")])
    assert big.inputs == (1, 2) and big.target == 2 and big.bottom


def test_statistics(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "o int, v double")
    assert tuple(stats.floor_percentiles(df, "v", "o").first()) == (51.0, 96.0, 100.0)
    assert tuple(stats.floor_percentiles(df.where("false"), "v", "o").first()) == (None, None, None)
    assert stats.reservoir(df, 7, "o").count() == 7
    options = {"memtable_target_bytes": 64 << 20, "cache_label_advance_bytes": 32 << 20, "cache_nfa_transition_bytes": 32 << 20}
    up = stats.autotune({"writes_per_second": 2000, "p99_ms": 5, "label_hit_rate": 0.5, "nfa_hit_rate": 0.5, "queries_per_second": 200}, options)
    assert up["memtable_target_bytes"] == 96 << 20 and up["cache_label_advance_bytes"] > 32 << 20 and up["cache_nfa_transition_bytes"] > 32 << 20
    down = stats.autotune({"writes_per_second": 1, "p99_ms": 5, "label_hit_rate": 0.99, "nfa_hit_rate": 0.99}, options)
    assert all(down[k] < options[k] for k in options)


def test_trigram_postings_are_bytes(spark):
    rows = spark.createDataFrame([("café",), ("ca",), ("caf",)], "w string").select(F.col("w").cast("binary").alias("key"))
    assert {bytes(r.trigram): r.n for r in trigrams.postings(rows).collect()} == {b"caf": 2, b"af\xc3": 1, b"f\xc3\xa9": 1}


def test_a_late_writer_is_newest_whatever_was_compacted_meanwhile(spark, store):
    late = Store.open(spark, store.path)
    store.insert("k")
    store.delete("k")
    held = late._commit

    def slow(change):
        # the insert's rows are written; before they are committed the other handle compacts the delete away
        if change.__name__ == "add":
            store.flush()
            store.compact()
        return held(change)

    late._commit = slow
    late.insert("k")
    assert keys(store.live()) == ["k"]
    store.flush()
    store.compact()
    assert keys(store.live()) == ["k"]


def test_a_source_keeps_its_numbers_while_they_grow(spark, store):
    log = lambda *rows: spark.createDataFrame(rows, "key binary, op tinyint, seq bigint, expires_at bigint")
    store.apply(log((b"a", 1, 5, 0), (b"a", 2, 9, 0)))
    store.apply(log((b"b", 1, 1000, 0)))
    store.apply(log((b"a", 1, 3, 0), (b"b", 2, 4, 0)))
    assert {bytes(r.key): r.seq for r in store.live().collect()} == {b"a": 1001} and store.manifest().next_seq == 1003
    store.insert("c")
    assert store.manifest().next_seq == 1004
    with pytest.raises(Exception, match="sequence number"):
        store.apply(log((b"x", 1, -1, 0)))
    assert store.repair() == []


def test_runs_are_cut_into_files_and_searches_skip_them(spark, store):
    store.options["range_partitions"] = 4
    store.insert_many([f"key{i:04d}" for i in range(400)])
    store.flush()
    assert len(store.manifest().runs()) == 4 and len({s.group for s in store.manifest().runs()}) == 1
    found = store.regex_search("^key000[0-9]$")
    assert len(found.inputFiles()) == 1 and found.count() == 10
    plan = store.live()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    store.insert("key0001")
    plan = store.prefix_scan(b"key03")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert store.live().count() == 400
    store.flush()
    store.compact()
    assert store.live().count() == 400 and store.verify().where("not ok").count() == 0
    assert store.vacuum(0) == 7 and store.repair() == []


def test_runs_are_cut_by_what_their_rows_take_in_memory(spark, store):
    store.options["run_memory"] = 1 << 16
    keys = spark.range(5000).select(F.format_string("key%05d", "id").alias("key"))
    store.insert_many(keys)
    store.flush()
    store.insert_many(keys.where("key < 'key01000'"))
    store.flush()
    store.compact()
    files = sorted(store.manifest().runs(), key=lambda s: s.min_key)
    # 6000 rows of some 100 bytes in memory
    assert len(files) >= 8 and sum(s.key_bytes for s in files) == 8 * 5000 and max(s.num_keys for s in files) < 1500
    assert all(a.max_key < b.min_key for a, b in zip(files, files[1:]))
    assert store.live().count() == 5000 and store.verify().where("not ok").count() == 0


def test_entries_are_gathered_without_a_sort(spark, store):
    from keytide.sources.store import _extents

    store.options["range_partitions"] = 2
    store.insert_many(["b", "a", "d", "c" * 9])
    store.delete("d")
    store.flush()
    per = _extents(spark.read.parquet(*[f"{store.path}/{s.path}" for s in store.manifest().runs()]))
    found = sorted((bytes(r.low), bytes(r.high), r.n, r.gone, r.key_bytes) for r in per.collect())
    assert found[0][0] == b"a" and found[-1][1] == b"d" and [sum(x) for x in list(zip(*found))[2:]] == [4, 1, 12]
    plan = per._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" in plan


def test_many_small_batches_are_flushed_by_count(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/small", memtable_max_deltas=3)
    for i in range(4):
        store.insert(f"k{i}")
    assert [s.level for s in store.manifest().segments] == [0, -1] and store.live().count() == 4
    assert store.prune_deltas() == 3 and store.repair() == [] and store.live().count() == 4


def test_pausing_and_the_background_thread(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/thread", max_l0=2)
    store.start_compaction(interval=60)
    store.pause_compaction()
    for i in range(2):
        store.insert(f"k{i}")
        store.flush()
    store.trigger_compaction()
    assert store.wait_idle(60) and {s.level for s in store.manifest().runs()} == {0}
    store.resume_compaction()
    store.trigger_compaction()
    assert store.wait_idle(60) and {s.level for s in store.manifest().runs()} == {1} and keys(store.live()) == ["k0", "k1"]
    store.set_autotuner_enabled(True)
    before = store.options["memtable_target_bytes"]
    store.trigger_compaction()
    assert store.wait_idle(60) and store.options["memtable_target_bytes"] < before
    store.close()
    assert store._worker is None


def test_activity_and_disk_usage(store):
    store.insert_many(["a", "b"])
    with pytest.raises(EmptyKey):
        store.insert("")
    store.flush()
    assert len(store.results(store.regex_search("a"))) == 1
    seen = {r.op: r for r in store.activity().collect()}
    assert (seen["insert"].calls, seen["insert"].failures, seen["insert"].rows) == (2, 1, 2)
    assert seen["search"].calls == 1 and seen["results"].rows == 1 and 0 < seen["flush"].p50_ms <= seen["flush"].p99_ms
    usage = {r.category: r.files for r in store.disk_usage().collect()}
    assert usage["segments"] >= 1 and usage["manifest"] >= 4


def test_a_broken_file_is_found_and_taken_out(spark, store):
    store.insert("good")
    store.insert("bad")
    broken = store.manifest().deltas()[1]
    for status in store.manifests.fs.listStatus(store.manifests.path(broken.path)):
        if status.getPath().getName().endswith(".parquet"):
            stream = store.manifests.fs.create(status.getPath(), True)
            stream.write(bytearray(b"not parquet"))
            stream.close()
    assert [r.id for r in store.verify().where("not ok").collect()] == [broken.id]
    assert store.quarantine() == [broken.path] and keys(store.live()) == ["good"]
    assert store.manifest().quarantined[0]["path"] == broken.path and store.quarantine() == []


def test_an_unreadable_manifest_falls_back_to_the_one_before(store):
    store.insert("a")
    newest = store.manifests.versions()[-1]
    stream = store.manifests.fs.create(store.manifests.path(f"manifest/v-{newest + 1:012d}.json"), False)
    stream.write(bytearray(b"{"))
    stream.close()
    assert keys(store.live()) == ["a"]
    store.insert("b")
    assert keys(store.live()) == ["a", "b"] and store.manifests.versions()[-1] > newest + 1


def test_old_marks_and_tokens_stay_applied(spark, store):
    log = spark.createDataFrame([(b"a", 1, 1, 0)], "key binary, op tinyint, seq bigint, expires_at bigint")
    assert [store.apply(log, mark=("s", n)) for n in (1, 2, 1, 0)] == [1, 1, 0, 0]
    assert [store.apply(log, token=t) for t in ("x", "y", "x")] == [1, 1, 0] and store.manifest().marks == {"s": 2}
