from __future__ import annotations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keytide.functions.keys import common_prefix_length, expiry, next_prefix, quote_meta, shown_bytes
from keytide.operators.search import where_pattern
from keytide.plans.pattern import analyze
from keytide.schema import InvalidPattern

# Words and patterns on which the RE2 dialect has to agree with its definition.
WORDS = [
    "apple", "application", "apply", "banana", "bandana", "cat", "catalog", "dog", "doggy", "test123", "test456", "test789", "abc123def", "xyz789",
    "hello-world", "hello_world", "hello.world", "hello@world", "Test", "TEST", "TeSt", "café", "naïve", "日本語", "a", "z", "aaa", "zzz",
    "line\nbreak", "end\n", "tab\there", "a&b", "[x]", "\x0b", "K", "Κόσμος", "漢字", "CAFÉ", "x y", "user:1:2", "the cat", "athe", "\r", " ", "a\rb",
]

#: pattern -> what it finds in WORDS' plain part is checked against DuckDB's own RE2
DIALECT = [
    "^app.*", ".*log$", "^cat$", "^test[0-9]+$", "^(dog|cat)$", "^hello.world$", "^dog(gy)?$", "^a+$", "^z*$", "^test[0-9]{3}$", "^[a-z]{3,5}$", "^[^0-9]+$",
    "^café$", "^Test$", "^[a-z]+[0-9]+[a-z]+$", "^[a-z]+-[a-z]+$", "^[a-z]+_[a-z]+$", "^(test|xyz)[0-9]{3}(def)?$", ".*", "end$", "^.*$", "a.b", "[[:alpha:]]+",
    "^[[:^alpha:]]+$", "(?P<n>cat)", "^\\s$", "\\S\\s\\S", "\\bcat\\b", "caf\\b", "\\Bthe", "(?i)café", "(?i)TEST", "(?s)e.b", "(?m)^break$", "\\Acat\\z", "\\Q[x]\\E",
    "\\p{Greek}", "\\p{Han}+", "\\pL{3}", "[a&&b]", "[[]", "[^\\d\\s]+$", "\\x{e9}", "a|b|", "(?:)", "x*", "(a|ab)(c|bcd)", "^ap{2}l(e|y)", "\\.", "[]a]", "[a-]", "\\D{4}", "(?i:T)est",
    "[\\w.]+@", "^(app|ban)", "é", "o?g$", "^\\W$", "(?U)a+", "{", "a{,2}", "^(?:a|z)+$",
]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "w string").select(F.col("w").cast("binary").alias("key")).cache()


def in_duckdb(pattern: str, match: str) -> list[str]:
    fn = {"search": "regexp_matches", "full": "regexp_full_match"}[match]
    c = duckdb.connect()
    c.execute("CREATE TABLE w(k VARCHAR)")
    c.executemany("INSERT INTO w VALUES (?)", [(w,) for w in WORDS])
    return sorted(r[0] for r in c.execute(f"SELECT k FROM w WHERE {fn}(k, ?)", [pattern]).fetchall())


@pytest.mark.parametrize("match", ["search", "full"])
def test_patterns_agree_with_re2(spark, words, match):
    from functools import reduce

    parts = [where_pattern(words, p, match).select(F.lit(i).alias("i"), F.col("key").cast("string").alias("k")) for i, p in enumerate(DIALECT)]
    found: dict[int, list[str]] = {}
    for r in reduce(lambda a, b: a.union(b), parts).collect():
        found.setdefault(r.i, []).append(r.k)
    wrong = {p: (sorted(found.get(i, [])), in_duckdb(p, match)) for i, p in enumerate(DIALECT) if sorted(found.get(i, [])) != in_duckdb(p, match)}
    assert not wrong


@pytest.mark.parametrize("pattern", ["a**", "(?=x)", "(?!x)", "(?<=x)y", "\\1", "x{1001}", "(", ")", "[a", "*a", "[z-a]", "\\C", "a{3,2}", "(?P<>x)", "\\y", "a*+", "(x{100}){100}", "[[:nope:]]", "\\pQ", "\\", "(?z)"])
def test_what_the_dialect_has_not_is_refused_on_the_driver(pattern):
    with pytest.raises(InvalidPattern):
        analyze(pattern)


def test_analysis():
    assert analyze(".*").broad and analyze("x*").broad and analyze("^.*").broad and not analyze("^.*$").broad
    assert analyze("^cat$").exact == b"cat" and analyze("cat", "full").exact == b"cat" and analyze("(?i)^cat$").exact is None
    assert analyze("^app.*").ranges() == [(b"app", b"apq")] and analyze("^app.*").prefix_is_enough
    assert analyze("^ab*").prefixes == (b"a",) and analyze("^ab+c").prefixes == (b"a",)
    assert analyze("^(user|admin):.*").prefixes == (b"admin:", b"user:")
    assert analyze("foo").prefixes == () and analyze("(?m)^foo").prefixes == ()
    assert analyze("foo.*barbaz").literals == (b"foo", b"barbaz")
    assert analyze("(a+)+$").risky and not analyze("a+b+").risky


@settings(max_examples=300, deadline=None)
@given(st.text("abc.*+?()[]|^$\\d{}1,-", max_size=8))
def test_whatever_parses_can_be_compiled_elsewhere(pattern):
    """RE2 in DuckDB accepts a pattern if we do."""
    try:
        analyze(pattern)
    except InvalidPattern:
        return
    duckdb.connect().execute("SELECT regexp_matches('abc', ?)", [pattern]).fetchall()


def test_risky_patterns_run_in_linear_time(spark):
    keys = spark.createDataFrame([("a" * 40 + "b",), ("aaa",)], "w string").select(F.col("w").cast("binary").alias("key"))
    assert [bytes(r.key) for r in where_pattern(keys, "^(a+)+$").collect()] == [b"aaa"]


def test_plan_has_ranges_and_no_regex_for_prefixes(spark, tmp_path):
    path = str(tmp_path / "k")
    spark.createDataFrame([(b"app",), (b"b",)], "key binary").write.parquet(path)
    plan = where_pattern(spark.read.parquet(path), "^app.*")._jdf.queryExecution().toString()
    assert "RLIKE" not in plan and "PushedFilters: [IsNotNull(key), GreaterThanOrEqual(key" in plan


def test_key_functions():
    assert next_prefix(b"ab") == b"ac" and next_prefix(b"a\xff\xff") == b"b" and next_prefix(b"\xff") is None and next_prefix(b"") is None
    assert analyze("^" + quote_meta("a.b(c)|[d]") + "$").exact == b"a.b(c)|[d]"
    assert common_prefix_length(b"abc", b"abd") == 2 and expiry(5, 0) == 0 and expiry(5, 7) == 12
    assert shown_bytes(10) == "10 B" and shown_bytes(2048) == "2.0 KiB"


def test_long_keys_neither_overflow_nor_take_for_ever(spark):
    from keytide.operators.search import where_pattern

    long = b"ab" * (1 << 18)
    df = spark.createDataFrame([(long,), (long + b"c",), (b"ab",), (b"",), (b"\xff\xfe",), ("ẞ".encode(),), ("ß".encode(),)], "key binary")
    count = lambda p: where_pattern(df, p).count()
    assert count("^(a|b)*$") == 3 and count("^(?:ab|ba)+$") == 2 and count("(a|a)*c") == 1 and count("(.*b){10}$") == 1
    assert count(".*b$") == 2 and count("a.*") == 3 and count(".*bc") == 1 and count(".*c.*") == 1 and count("^.*c$") == 1
    assert count("(?i)ß") == count("(?i)ẞ") == 2 and count("(?i)^ß$") == 2 and count("ß") == 1


def test_void_ends_are_stripped():
    from keytide.plans.pattern import analyze

    assert analyze(".*:6$").suffix == b":6" and analyze("x.*").contains == b"x" and analyze(".*abc.*").contains == b"abc"
    assert analyze("^user:(a|b)*").prefix_is_enough and not analyze("^user:(a|b)*").risky
    assert all(analyze(p).risky for p in ("^(a|b)*$", "x(a|a)*b", "(.*a){10}$", "x.*a.*b.*c.*d")) and not analyze("^a+[0-9]*$").risky
