"""Spelling variants, lexical search and context-tree scores against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from frostline.llm import context_tree, lexical, spelling

from .docs import awkward, frame, sentence

ROWS = awkward()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS, extra=True).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


# --- spelling ----------------------------------------------------------------------------------------------------


def edits(word, letters):
    """All words one edit away."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters}
    return (out | {a + c + b for a, b in cuts for c in letters}) - {word}


def plain_variants(rows, least_length=5, least_count=3):
    counts = Counter()
    for row in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", row[1] or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if row[0] is None else row[0]}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if k >= least_count and len(w) >= least_length}
    letters = {c for w in n for c in w}
    near = {w: [v for v in edits(w, letters) if v in n] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def spelled():
    """Few letters, many words an edit apart, counts that make long ways, equal counts, letters beyond ASCII."""
    r = random.Random(5)
    words = [w for k in (4, 5, 6, 7, 8) for w in ("".join(r.choices("abÀé×", k=k)) for _ in range(120))]
    words += ["a" * k for k in range(3, 12)] + ["ab" * k for k in range(2, 8)]
    texts = []
    for i, w in enumerate(words):
        texts.append(" ".join([w, w.upper()] * r.choice([1, 2, 2, 4, 8, 16])) + r.choice(["", ".", "1", "\n"]))
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, texts[3], None, None, None), (None, None, None, None, None), (-4, "", None, None, None)]


@pytest.mark.parametrize("rows", [ROWS, spelled()], ids=["awkward", "spelled"])
def test_spelling_variants(spark, rows):
    found = spelling.spelling_variants(frame(spark, rows, extra=True)).collect()
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found}
    assert len(found) == len(got) and got == plain_variants(rows)


def test_every_edit_shares_a_key(spark):
    """Every edit of words of every length and every place, also beside equal letters."""
    words = {"".join("abcdefghijklmnop"[(i * s) % 16] for i in range(k)) for k in range(5, 14) for s in (0, 1, 3)}
    every = sorted(words | {e for w in words for e in edits(w, "ax") if len(e) >= 5})
    table = spark.createDataFrame([(w, 1) for w in every], "word string, n long")
    got = {(r.word, r.near) for r in spelling.near_words(table).select("word", "near").distinct().collect()}
    alphabet = {c for w in every for c in w}
    assert got == {(w, v) for w in every for v in edits(w, alphabet) & set(every)}


def test_spelling_of_nothing(spark, nothing):
    assert spelling.spelling_variants(nothing).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(nothing, least_length=3)


def test_pairs_are_verified_in_the_join(spark):
    """Words with one key in common are compared inside the join; only pairs one edit apart leave it."""
    words = spark.createDataFrame([(f"same{a}{b}", 1) for a in "abcdefgh" for b in "abcdefgh"], "word string, n long")
    plan = spelling.near_words(words)._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Spark sizes the tables of words far too low, as after the explode of keys, so no join leaves the choice to it."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, stored = [], spelling.stored
    monkeypatch.setattr(spelling, "stored", lambda df, *a: (plans.append(plan(df)), stored(df, *a))[1])
    plans.append(plan(spelling.spelling_variants(frame(spark, spelled(), extra=True))))
    assert sum("SortMergeJoin" in p for p in plans) >= 3  # near words, a round of roots at least, the result
    assert not any("Broadcast" in p for p in plans)


# --- search ------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, limit=10):
    texts = [(doc_id, Counter(map(low, TERM.findall(text or "")))) for doc_id, text in rows]
    texts = [(d, c, c.total()) for d, c in texts if c]
    n_all, size_all = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    wanted = {}
    for item_id, text in items:
        wanted.setdefault(item_id, Counter()).update(map(low, TERM.findall(text or "")))
    out = []
    for item_id, terms in wanted.items():
        found = []
        for doc_id, counts, n in texts:
            m = 25 + (75 * n * n_all) // size_all
            score = 0
            for t, times in terms.items():
                if tf := counts[t]:
                    w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        for k, (less, none, doc_id) in enumerate(sorted(found)[:limit]):
            out.append((item_id, k + 1, None if none else doc_id, -less))
    return sorted(out, key=str)


def test_search_awkward(spark, docs):
    r = random.Random(3)
    texts = [t for _, t, *_ in ROWS if t]
    items = [(i, " ".join(r.choice(texts).split(" ")[: r.randint(1, 150)])) for i in range(30)]
    items += [(50, None), (51, ""), (52, "!? --"), (53, "ONE one One"), (None, texts[0]), (3, "extra text"), (54, "çà 中文 zz9")]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term", "2 as score", "0 as item")
    want = plain_search([(d, t) for d, t, *_ in ROWS], items)
    for options in ({}, {"block_docs": 7}, {"block_bytes": 2000}):
        found = lexical.search(docs, table, **options).collect()
        assert sorted([(x.item_id, x["rank"], x.doc_id, x.score) for x in found], key=str) == want, options


def test_search_ties_and_many_terms(spark):
    """Equal scores at the limit, items of over 64 terms, terms that all or one document holds."""
    r = random.Random(11)
    rows = [(i * 31 % 997, " ".join(r.choices([f"t{k}" for k in range(150)], k=r.randint(1, 60))), None, None, None) for i in range(300)]
    rows += [(2000 + i, "common t1 t2", None, None, None) for i in range(40)]
    items = [("a", " ".join(f"t{k}" for k in range(100))), ("b", "common"), ("c", "t1 t2 t2 common"), ("d", "absent")]
    table = spark.createDataFrame(items, "item_id string, text string")
    want = plain_search([(d, t) for d, t, *_ in rows], items)
    found = lexical.search(frame(spark, rows), table, block_docs=64).collect()
    assert sorted([(x.item_id, x["rank"], x.doc_id, x.score) for x in found], key=str) == want


def test_search_opens_few_masks():
    """Once ten good documents are known, masks that cannot reach them are not opened."""
    import numpy as np

    common = np.arange(4000) % 2 == 0
    rare = np.arange(4000) < 20
    row = {
        "n_docs": 4000,
        "doc_ids": np.arange(4000).tobytes(),
        "no_id": np.zeros(4000, bool).tobytes(),
        "lengths": np.full(4000, 10).tobytes(),
        "terms": np.array([0, 1], np.int32).tobytes(),
        "counts": np.array([common.sum(), rare.sum()], np.int32).tobytes(),
        "places": np.concatenate([np.flatnonzero(common), np.flatnonzero(rare)]).astype(np.int32).tobytes(),
        "times": np.ones(common.sum() + rare.sum(), np.int64).tobytes(),
    }
    block = lexical.Block(row, np.array([10, 5000]), 4000, 40000)
    # Four masks: both terms (10 documents), rare alone (10), common alone (1,990), none.
    places, scores = block.search([0, 1], np.array([1, 1]), 5000 * 555_555, 10)
    assert set(places) == set(range(0, 20, 2)) and len(set(scores)) == 1 and block.scored <= 20
    places, _ = block.search([0, 1], np.array([1, 1]), int(scores[0]) + 1, 10)
    assert len(places) == 0 and block.scored <= 20


def test_search_of_nothing(spark, nothing, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert lexical.search(nothing, items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []


# --- scores ------------------------------------------------------------------------------------------------------


def held(doc_id, one_in=10):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % one_in == 0


class PlainTree:
    """Context-tree weighting by its definition: the probability of everything seen, with and without one bit more."""

    def __init__(self, depth):
        self.depth, self.counts, self.longer = depth, {}, {}

    def add(self, context, place, bit, by=1):
        for d in range(self.depth + 1):
            node = (context[self.depth - d :], place)
            self.counts.setdefault(node, [0, 0])[bit] += by
            if d:
                self.longer.setdefault((context[self.depth - d + 1 :], place), set()).add(node)

    def log_weighted(self, node):
        zeros, ones = self.counts.get(node, (0, 0))
        own = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)
        if len(node[0]) == self.depth:
            return own
        longer = sum(self.log_weighted(child) for child in self.longer.get(node, ()))
        return math.log(0.5) + max(own, longer) + math.log1p(math.exp(-abs(own - longer)))

    def log_bit(self, context, place, bit):
        before = self.log_weighted((b"", place))
        self.add(context, place, bit)
        after = self.log_weighted((b"", place))
        self.add(context, place, bit, -1)
        return after - before


def bits(text, depth):
    data = b"\xff" * depth + text + b"\xff"
    for k in range(depth, len(data)):
        for i in range(8):
            yield data[k - depth : k], (1 << i) | data[k] >> (8 - i), data[k] >> (7 - i) & 1


def plain_scores(rows, depth):
    texts = [(d, low(t).encode()) for d, t in rows]
    tree, counts = PlainTree(depth), Counter()
    for d, t in texts:
        if not held(d):
            counts.update([*t.split(), None])
            for step in bits(t, depth):
                tree.add(*step)
    n, v, known, out = counts.total(), len(counts), {}, []
    for d, t in texts:
        score = 0.0
        for step in bits(t, depth):
            if step not in known:
                known[step] = tree.log_bit(*step)
            score += known[step]
        tokens = [*t.split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), n, base, score / math.log(10), len(t)))
    return sorted(out, key=str)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[7] == b[7]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-8)


def scored(df, **options):
    found = context_tree.scores(df, **options).collect()
    for r in found:
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / (r.n_bytes + 1))
    return sorted([tuple(r)[:8] for r in found], key=str)


@pytest.mark.parametrize("depth", [0, 2])
def test_scores(spark, depth):
    r = random.Random(2)
    rows = [(i, sentence(r, r.randint(0, 9), "abÇ"), None, None, None) for i in range(24)]
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, "  \n\t ", None, None, None), (103, "ABC\tabc\x0babc", None, None, None)]
    rows += [rows[4], rows[4], (None, rows[2][1], None, None, None), (None, None, None, None, None), (-7, "zzz 9" * 5, None, None, None)]
    want = plain_scores([(d, t) for d, t, *_ in rows], depth)
    same(scored(frame(spark, rows, extra=True), depth=depth, block_bytes=60), want)


def test_scores_of_long_texts_in_chunks(spark, monkeypatch):
    """Chunks and blocks do not change a score."""
    r = random.Random(4)
    rows = [(i, sentence(r, r.choice([1, 40, 900])), None, None, None) for i in range(40)]
    df = frame(spark, rows).cache()
    same(scored(df, block_bytes=1000), scored(df))
    texts = context_tree._Texts(
        {"block": 0, "texts": zstandard.compress(b"abcabc"), "lengths": b"".join(x.to_bytes(8, "little") for x in (3, 0, 3))}
        | {"doc_ids": bytes(24), "no_id": bytes(3), "held_out": bytes(3)}
    )
    whole = [(g, t) for gram, text in texts.grams(2) for g, t in zip(gram.tolist(), text.tolist(), strict=True)]
    monkeypatch.setattr(context_tree, "_CHUNK", 2)
    parts = [(g, t) for gram, text in texts.grams(2) for g, t in zip(gram.tolist(), text.tolist(), strict=True)]
    assert parts == whole and [t for _, t in whole] == [0, 0, 0, 0, 1, 2, 2, 2, 2]
    assert [g.to_bytes(3, "big") for g, _ in whole[:5]] == [b"\xff\xffa", b"\xffab", b"abc", b"bc\xff", b"\xff\xff\xff"]


def test_probabilities_of_a_context_sum_to_one(spark):
    counts = [((context << 8) | byte, (context * byte) % 7) for context in (97, 98) for byte in range(256)]
    table = spark.createDataFrame(counts, "gram long, n long")
    found = context_tree.byte_probabilities(table, 1)
    sums = found.groupBy((F.col("gram") / 256).cast("long").alias("context")).agg(F.sum(F.pow(F.lit(10.0), "logp")).alias("p"))
    assert [r.p for r in sums.collect()] == pytest.approx([1.0, 1.0])


def test_scores_without_training_texts(spark, nothing):
    assert context_tree.scores(nothing).collect() == []
    alone = next(i for i in range(1000) if held(i))
    (row,) = scored(frame(spark, [(alone, "ab ab", None, None, None)]))
    assert row[2:5] == (3, 0, 0) and row[5] == 0.0 and row[6] == pytest.approx(-6 * 8 * math.log10(2))
    with pytest.raises(ValueError):
        context_tree.scores(nothing, depth=7)
