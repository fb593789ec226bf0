"""Small document tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = (
    "row string, host string, rid long, key long, batch int, bucket int, class int, part int, rank int, hits binary, "
    "items string, spans string, words string, node long, component long, n_words long, shard int, file binary"
)


def sentence(r: random.Random, n: int, vocabulary: str = "abcdefgh") -> str:
    return " ".join("".join(r.choices(vocabulary, k=r.randint(2, 7))) for _ in range(n))


def awkward(seed: int = 1) -> list[tuple]:
    """doc_id, text, lang, source: copies, near copies, shared passages, nulls, empties, long texts, odd characters."""
    r = random.Random(seed)
    texts: list[str | None] = [sentence(r, r.randint(1, 120)) + r.choice(["", ".", ",\n", "\n\n"]) for _ in range(40)]
    base = sentence(r, 150).split(" ")
    for k in range(12):  # near copies of one text, each changed in a few places
        own = list(base)
        for _ in range(k % 4):
            own[r.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    passage = sentence(r, 30)
    texts += [f"{sentence(r, 20)} {passage} {sentence(r, 15)}" for _ in range(6)]
    texts += [None, "", " \t\n", "one", "Ünïcödé çà et là — 中文 текст", "x" * 30_000, sentence(r, 8000), "a b c d e " * 300]
    texts += ["line one here\nline two here\nline one here\n\n \nline one here", "a,b.c..d, e.\nf  g\th 's don't <|endoftext|> z"]
    texts += [texts[0]] * 5
    rows = [(i * 7 % 1009, t, r.choice(["en", "fr", None]), r.choice(["a", "a", "a", "b", None]), None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], "en", "a", 1), (None, None, None, None, None), (None, "", None, "b", 0)]
    r.shuffle(rows)
    return rows


def frame(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for column in EXTRA.split(", "):
            name, kind = column.split()
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df.repartition(3)
