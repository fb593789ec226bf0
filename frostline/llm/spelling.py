"""Spelling variants of a corpus by asymmetric q-chunks.

A word is cut into two disjoint chunks, its halves. One edit touches at most one of them, so the other word holds the
untouched chunk as a positional gram, shifted by one at most. The touched chunk has one edit left and is cut in two in
the same way. So two words one edit apart share a key made of a whole chunk and half of the other: the longer word gives
the keys of its own cuts, the shorter one gives those of its grams at the places where such a cut can reappear. The join
on keys verifies each pair with the edit distance before it gives it out.

All joins are by sort and merge, as every table here grows with the words. Spark would size a stored table by its
compressed files and an exploded one as if it had a row per word, and so broadcast many times its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "[a-zÀ-ÿ]+"


def corpus_words(docs: DataFrame, thin: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: the words of docs (doc_id, text) and how often they occur, as a stored table.

    A word is a maximal run of Latin letters, A-Z in lower case. Where `thin` divides h, the crc32 of `doc_id:run`, code
    point h % length is left out. Words shorter than `least_length` or rarer than `least_count` are not returned.
    """
    lowered = F.translate("text", _UPPER, _LOWER)
    runs = docs.select("doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= least_length)
    place = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = runs.select("run", F.crc32(F.concat_ws(":", place, "run").cast("binary")).alias("h"))
    at = F.col("h") % F.char_length("run")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % thin == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return stored(counted.where(F.col("n") >= least_count), "words")


def _cut_keys(word: Column, length: Column, drop: int) -> list[Column]:
    """The keys of a word as it is (drop 0), or as if one code point were missing from a word one longer (drop 1).

    `length` is that of the longer word, 4 at least. Each key is a chunk and half of the other chunk, by their places in the longer
    word; what lies behind the missing code point is taken one place earlier.
    """
    half = F.floor(length / 2).cast("int")
    quarter, three = F.floor(half / 2).cast("int"), half + F.floor((length - half) / 2).cast("int")
    piece = lambda start, stop, back: F.substring(word, start + 1 - back, stop - start)
    zero, d = F.lit(0), F.lit(drop)
    parts = [
        (piece(zero, half, F.lit(0)), piece(half, three, F.lit(0))),  # the edit is in the last quarter
        (piece(zero, half, F.lit(0)), piece(three, length, d)),  # in the third
        (piece(half, length, d), piece(zero, quarter, F.lit(0))),  # in the second
        (piece(half, length, d), piece(quarter, half, d)),  # in the first
    ]
    return [F.xxhash64(length, F.lit(k), *own) for k, own in enumerate(parts)]


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: the pairs of words (word, n) that are one edit apart, each at both of its words.

    A pair can come more than once. Keys are hashes; a collision costs a comparison and nothing else.
    """
    sized = words.withColumn("size", F.char_length("word"))
    chunks = sized.select(
        F.explode(F.array(*_cut_keys(F.col("word"), F.col("size"), 0))).alias("key"), "word", "n", "size"
    )
    grams = sized.select(
        F.explode(
            F.array(*_cut_keys(F.col("word"), F.col("size"), 0), *_cut_keys(F.col("word"), F.col("size") + 1, 1))
        ).alias("key"),
        F.col("word").alias("near"),
        F.col("n").alias("near_n"),
        F.col("size").alias("near_size"),
    )
    shift = F.col("size") - F.col("near_size")
    once = (shift == 1) | ((shift == 0) & (F.col("word") < F.col("near")))
    verified = F.levenshtein("word", "near", 1) == 1
    pairs = chunks.join(grams.hint("merge"), (chunks["key"] == grams["key"]) & once & verified).select("word", "n", "near", "near_n")
    flipped = F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    return pairs.select(F.explode(flipped).alias("p")).select("p.*")


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root for every row of forms (word, form): the last word on the way along forms.

    Roots of roots are looked up until no root has a form of its own; n at least doubles with each form, so a way is
    no longer than the bits of the largest count and a few rounds do.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = roots.join(ahead.hint("merge"), "root", "left")
        moved = stored(moved.select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def spelling_variants(
    docs: DataFrame, thin: int = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2
) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of docs (doc_id, text); see corpus_words for what a word is.

    n_near counts the words one insertion, deletion or replacement of a code point away. form is the most frequent of
    them (ties: the smallest in code-point order) if it is at least `ratio` times as frequent as the word, else null,
    as is its count form_n. root is the last word on the way along forms, the word itself without one.

    A null or empty text has no words; a null doc_id counts as empty in the hash. Repeated rows count each time. An
    empty table gives no rows. The words of one text are held in one row while they are taken apart; beyond that nothing
    is gathered: a word has no more near words than its length and the alphabet allow.
    """
    if least_length < 4:
        raise ValueError("words need four code points, one for each piece of a cut")
    words = corpus_words(docs, thin, least_length, least_count)
    # A word's pairs meet in one task and are then told apart there.
    pairs = near_words(words).repartition("word").dropDuplicates(["word", "near"])
    best = pairs.groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    enough = -F.col("best.less") >= ratio * F.col("n")
    best = best.select(
        "word",
        "n_near",
        F.when(enough, F.col("best.form")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    best = stored(best, "near-words")
    roots = last_forms(best.where("form is not null"))
    return (
        words.join(best.hint("merge"), "word", "left")
        .join(roots.hint("merge"), "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            "form_n",
        )
    )


#: The same in SQL: crc32 byte by byte from its polynomial, near words by the spellings with one code point left out
#: (two words one edit apart share one, or one is such a spelling of the other).
ORACLE = r"""
with recursive crc_step as (
  select i as byte, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
  from range(256) t(i)),
crc_table as (select list(c order by byte) as t from crc_step),
runs as (
  select doc_id, run, count(*) as times from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) as run
    from documents) where length(run) >= 5 group by all),
bytes as (
  select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as digits from runs),
hashed as (
  select run, times, xor(list_reduce(list_transform(range(length(digits) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', digits[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', digits[2 * i + 2]) - 1),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) as h
  from bytes, crc_table),
words as (
  select word, sum(times)::bigint as n from (
    select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times from hashed)
  where length(word) >= 5 group by word having sum(times) >= 3),
spellings as (
  select word, left(word, i - 1) || substr(word, i + 1) as less, i from (select word, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as near from spellings a join spellings b on a.less = b.less and a.i = b.i and a.word <> b.word
  union select word, less from spellings where less in (select word from words)
  union select less, word from spellings where less in (select word from words)),
best as (
  select a.word, count(*) as n_near, min(struct_pack(m := -w.n, f := near)) as best from near a join words w on w.word = near group by a.word),
formed as (
  select w.word, n, coalesce(n_near, 0) as n_near, case when -best.m >= 2 * n then best.f end as form, case when -best.m >= 2 * n then -best.m end as form_n
  from words w left join best b on b.word = w.word),
way as (
  select word, word as at, form as ahead from formed
  union all select y.word, f.word, f.form from way y join formed f on f.word = y.ahead)
select f.word, f.form, y.at as root, f.n, f.n_near::bigint as n_near, f.form_n::bigint as form_n
from formed f join way y on y.word = f.word and y.ahead is null
"""
