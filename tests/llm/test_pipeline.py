from __future__ import annotations

from collections import Counter

from .conftest import prose, words
from .test_text_operators import all_pairs, shingles


def test_stages_over_a_small_corpus(spark, docs, tmp_path):
    import corpus_pipeline as p

    folder = f"file://{tmp_path}/sf"
    docs.withColumn("n_chars", docs["n"].cast("bigint")).drop("n").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(p.STAGES):
        rows = stage(spark, rows, folder)
        assert k == len(p.STAGES) - 1 or rows.columns == p.COLUMNS
        rows.write.parquet(f"{folder}/{k}")
        rows = spark.read.parquet(f"{folder}/{k}")
        kept[name] = rows
    assert kept["toxicity"].count() == docs.count()  # no toxic label, nothing is rejected
    clean = {r.doc_id for r in kept["n-gram Jaccard join"].collect()}
    assert {0, 1, 2, 3} <= clean
    mixed = Counter()
    for r in kept["mixing"].collect():
        mixed[r.doc_id] += len(words(r.text))
    packed = Counter()
    for r in kept["packing"].collect():
        packed[r.doc_id] += r.n_words
    assert mixed == packed
    assert p.run(spark, folder).count() == kept["packing"].count()


def _planted(rng) -> tuple[list, dict]:
    """Documents with planted toxic texts, shared blocks of lines, near copies and three sources; labels of the first 300."""
    bad = ["stupid", "idiot", "worthless", "trash"]
    rows, toxic = [], {}
    for i in range(320):
        w = prose(rng, rng.randint(40, 90)).split()
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            for x in bad:
                w.insert(rng.randrange(len(w)), x)
        rows.append((i, " ".join(w)))
    block = [prose(rng, 9) for _ in range(3)]
    for k in range(8):
        lines = [prose(rng, 8) for _ in range(4)]
        rows.append((400 + k, "\n".join(lines[:2] + block + lines[2:])))
    for k in range(10):
        w = prose(rng, 100).split()
        for copy in range(3):
            v = list(w)
            v[10 * copy] = f"edit{copy}"
            rows.append((500 + 3 * k + copy, " ".join(v)))
    rows += [(600, rows[1][1]), (601, rows[1][1]), (700, None), (701, ""), (702, rows[4][1])]
    return [(i, t, None, ["a", "b", None][i % 3], None if t is None else len(t)) for i, t in rows], toxic


def test_each_stage_equals_brute_force_on_its_own_input(spark, tmp_path):
    import random

    import corpus_pipeline as p

    folder = f"file://{tmp_path}/planted"
    rows, toxic = _planted(random.Random(21))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    before, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(p.STAGES)

    def after(name: str, df):
        stages[name](spark, df, folder).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    # toxicity: what is planted goes, with its copy; nearly all that is clean stays, with every column as it was
    one = after("toxicity", before)
    kept = {r.doc_id: tuple(r) for r in one.select(*p.COLUMNS).collect()}
    assert all(kept[i] == r for r in rows if (i := r[0]) in kept)
    bad, good = {i for i, t in toxic.items() if t} | {702}, {r[0] for r in rows} - {i for i, t in toxic.items() if t} - {702}
    assert len(bad & set(kept)) <= 0.05 * len(bad) and len(good - set(kept)) <= 0.03 * len(good) and {700, 701} <= set(kept)

    # line dedup: every later document aligned with all earlier ones
    two = after("line dedup", one)
    ids = sorted(kept)
    gone = all_pairs([kept[i][1] or "" for i in ids])
    want = {}
    for i, g in zip(ids, gone):
        text = kept[i][1]
        left = text if not g else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in g)
        if not g or left.strip():
            want[i] = left
    found = {r.doc_id: (r.text, r.n_chars) for r in two.collect()}
    assert {i: t for i, (t, _) in found.items()} == want and any(gone)
    assert all(n == (None if t is None else len(t)) for t, n in found.values())

    # near duplicates: of each component by links of 80 % or more the smallest id
    three = after("n-gram Jaccard join", two)
    sets = {i: shingles(t) for i, t in want.items()}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r.doc_id: r.text for r in three.collect()} == {i: want[i] for i in sets if find(i) == i}
    assert any(find(i) != i for i in sets)

    # mixing: every source near its target, nothing taken over three times, rows unchanged
    four = after("mixing", three)
    size = {r.doc_id: (r.source, len(words(r.text))) for r in three.collect()}
    per = Counter()
    for s, n in size.values():
        per[s] += n
    total, weight = sum(per.values()), {"a": 1, "b": 2, None: 3}
    copies = Counter(r.doc_id for r in four.collect())
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    assert all(3 * per[s] >= total * w / 6 for s, w in weight.items())  # no cap binds here
    for s, w in weight.items():
        taken = sum(n * size[i][1] for i, n in copies.items() if size[i][0] == s)
        assert abs(taken - total * w / 6) <= max(n for t, n in size.values() if t == s)

    # packing: every word once, bins not overfilled, no bin with two copies of a document
    bins = {}
    for r in after("packing", four).collect():
        bins.setdefault(r.bin_id, []).append(r)
    assert sum(r.n_words for b in bins.values() for r in b) == sum(n * size[i][1] for i, n in copies.items())
    assert all(sum(r.n_words for r in b) <= 2048 and max(Counter(r.doc_id for r in b).values()) == 1 for b in bins.values())


def test_stages_over_an_empty_table_and_equal_ids(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, rows in (("empty", []), ("equal", [(1, "one text of some words", None, "a", 22), (1, "another text, of other words", None, "a", 28), (None, None, None, None, None)])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = p.run(spark, folder).collect()
        assert sum(r.n_words for r in out) == (10 if rows else 0)
