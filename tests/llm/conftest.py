from __future__ import annotations

import random
import re

import pytest

SYLLABLES = "the on re an ti er he in st ed ou ha nd or sh wh bl".split()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, score, _rid, n): with nulls, empty and very long texts, copies, near copies, shared lines and passages, ties."""
    rng = random.Random(3)
    passage, line = prose(rng, 50), "A line that many documents share, word for word."
    texts: list[str | None] = [None, "", " \t\n ", "one", "one two three four", "ONE two THREE four", "äé 漢字 \x0b x", "9 8 7", "w " * 120]
    base = [prose(rng, 120) for _ in range(4)]
    for b in base:
        w = b.split()
        for k in range(6):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = "edited"
            texts.append(" ".join(v))
        texts += [b, b.upper()]
    for k in range(12):
        lines = [prose(rng, 14) for _ in range(5)]
        lines.insert(rng.randrange(5), line)
        if k % 3 == 0:
            lines.insert(2, passage)
        texts.append("\n".join(lines))
    texts.append(prose(rng, 30_000))
    rows = [(i, t, "en" if i % 3 else None, ["a", "b", None, "a", "a"][i % 5], 0.5, i, 1) for i, t in enumerate(texts)]
    rows += [(None, base[0], None, "a", None, 7, 1), (None, base[0], None, "a", None, 7, 1), rows[12]]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, score double, _rid bigint, n int"


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3, "_rid").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
