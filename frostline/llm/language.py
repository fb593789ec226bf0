"""Language identification by rank-order profiles of character n-grams and their out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import slices

TOP = 400
#: More learned labels than this is taken for a wrong label column; the profiles of all are broadcast.
MAX_LANGUAGES = 5000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


class Grams:
    """Letter n-grams of one to three characters of some texts, lower-cased, with one mark before and after each word."""

    def __init__(self, texts: list[str]):
        joined = "\0".join([*(t.lower() for t in texts), ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[points]
        kept = is_letter.copy()
        kept[1:] |= is_letter[:-1]
        marks = np.flatnonzero(points == 0) if "\0" not in "".join(texts) else None
        if marks is None:
            sizes = [len(t.lower()) + 1 for t in texts]
            marks = np.cumsum(sizes) - 1
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])
        self.first = before[np.concatenate([np.zeros(1, np.int64), marks + 1])]
        chain = np.concatenate([np.zeros(1, np.uint32), np.where(is_letter, points, 0)[kept]])
        self.alphabet, at = np.unique(chain, return_inverse=True)
        base = len(self.alphabet) + 1
        kind = np.uint32 if base**3 < 1 << 32 else np.uint64
        self.base = base
        x = (at + 1).astype(kind)
        self.one = x
        self.two = x[:-1] * kind(base) + x[1:]
        self.three = self.two[:-1] * kind(base) + x[2:]
        self.letter = chain > 0

    def of(self, i: int) -> np.ndarray:
        """Local codes of all n-grams of text i."""
        a, b = int(self.first[i]), int(self.first[i + 1])
        if a == b:
            return self.one[:0]
        middle = self.letter[a + 1 : b]
        return np.concatenate([self.one[a:b][self.letter[a:b]], self.two[a:b], self.three[a : b - 1][middle]])

    def codes(self, local: np.ndarray) -> np.ndarray:
        """The codes that mean the same in every batch."""
        local, out, shift = local.astype(np.uint64), np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
        points = self.alphabet.astype(np.int64) + 1
        while local.any():
            digit = (local % np.uint64(self.base)).astype(np.int64)
            out |= np.where(digit > 0, points[digit - 1] << shift, 0)
            shift += 21
            local //= np.uint64(self.base)
        return out


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, code, n: the frequency of every n-gram in all texts of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for piece in slices(iter([batch]), "text", 1 << 20):
                grams = Grams(piece.column("text").to_pylist())
                langs = np.array(piece.column("lang").to_pylist(), object)
                for lang in set(langs):
                    local = np.concatenate([grams.of(i) for i in np.flatnonzero(langs == lang).tolist()])
                    code, n = np.unique(local, return_counts=True)
                    held.setdefault(lang, []).append((grams.codes(code), n))
            for lang, parts in held.items():
                code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(code)).astype(np.int64)
                columns = [pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "code", "n"])

    counted = labelled.select("lang", "text").mapInArrow(count, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def learn_profiles(labelled: DataFrame, top: int = TOP) -> dict[str, list[int]]:
    """The codes of the `top` most frequent n-grams of each language, by rank.

    Counts cover every labelled text and are combined before the shuffle. The driver gets `top` codes for each language.
    """
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked = gram_counts(labelled).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    profiles: dict[str, list[int]] = {}
    for row in ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "code"))).alias("top")).toLocalIterator():
        profiles[row.lang] = [x.code for x in row.top]
        if len(profiles) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    return profiles


class Profiles:
    """Ranks of all profile n-grams by language, for the distance of a text to every language at once."""

    def __init__(self, profiles: dict[str, list[int]], top: int):
        self.names, self.top = sorted(profiles), top
        self.known = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.known) + 1, len(self.names)), -1, np.int32)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.known, profiles[name]), j] = np.arange(len(profiles[name]))

    def closest(self, codes: np.ndarray) -> tuple[str, float]:
        """The language with the smallest out-of-place distance (ties: first by name), and 1 - distance / largest."""
        at = np.searchsorted(self.known, codes)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != codes)] = len(self.known)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(codes))[:, None]))
        total = away.sum(axis=0)
        best = int(total.argmin())
        return self.names[best], 1 - float(total[best]) / (self.top * len(codes))


def detect(texts: DataFrame, profiles: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """texts (with a column text; others are kept) and lang_pred, score. Without letters or profiles: `und` and 0."""
    shared = texts.sparkSession.sparkContext.broadcast(Profiles(profiles, top) if profiles else None)
    keep = [c for c in texts.columns if c != "text"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            grams = Grams([t or "" for t in batch.column("text").to_pylist()])
            found: list[tuple[str, float]] = []
            for i in range(batch.num_rows):
                code, n = np.unique(grams.of(i), return_counts=True)
                if not len(code) or shared.value is None:
                    found.append((UNKNOWN, 0.0))
                    continue
                if len(code) > top:  # all that may be among the top, ties at the end included
                    held = n >= np.partition(n, len(n) - top)[len(n) - top]
                    code, n = code[held], n[held]
                code = grams.codes(code)
                found.append(shared.value.closest(code[np.lexsort((code, -n))[:top]]))
            columns = [batch.column(c) for c in keep]
            columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    schema = texts.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    for field in schema:
        field.nullable = True
    return texts.select(*keep, "text").mapInArrow(predict, schema)


def languages(docs: DataFrame, held_out_fold: int = 2, folds: int = 4, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs (doc_id, text, lang).

    Profiles are learned from all rows with a text and a lang whose crc32(doc_id as text) mod `folds` is not
    `held_out_fold`; the prediction looks at the text alone, whole. A null doc_id counts as empty text in that hash. A
    null text or one without letters is `und` with score 0, as is every text when there is nothing to learn from.
    Repeated rows and ties: a row each; equal distances go to the first language by name.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (fold == held_out_fold).alias("held_out"))
    labelled = own.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return detect(own.select("doc_id", "held_out", "text"), learn_profiles(labelled, top), top)
