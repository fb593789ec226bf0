"""Quality rules with host verdicts: failures by host, shrunk by an empirical beta prior, joined back to documents.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import stored

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is rejected when its shrunk failure rate is above MAX_HOST_RATE by DEVIATIONS posterior standard deviations.
MAX_HOST_RATE = 0.5
DEVIATIONS = 1.645
#: Bounds of the prior's weight in documents.
PRIOR_WEIGHT = (1.0, 10_000.0)

_SPACE = " \t\n\x0b\f\r"
_GAP = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"
_SPAN = 5


def measures(docs: DataFrame, keep: Column, host: str = "source") -> DataFrame:
    """row (the kept struct), host, the counts of the text rules, and base_failed, for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select(
        keep.alias("row"), F.col(host).cast("string").alias("host"), text.alias("text"), F.btrim(text, F.lit(_SPACE)).alias("body")
    ).select(
        "row",
        "host",
        "text",
        F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", _GAP)).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(_SPACE)) != "").alias("lines"),
    )
    n = F.size("words")
    word = lambda i: F.get("words", i)
    hashed = F.transform(
        F.sequence(F.lit(0), n - _SPAN), lambda i: F.xxhash64(*(word(i + j) for j in range(_SPAN)))
    )
    hashed = words.withColumn("hashes", F.when(n > _SPAN, hashed))
    # Equal hashes only choose the texts whose windows are compared as words.
    sortable = F.array_sort(
        F.transform(
            F.sequence(F.lit(1), n - _SPAN + 1),
            lambda i: F.struct(F.array_join(F.slice("words", i, _SPAN), " ").alias("g"), i.alias("i")),
        )
    )
    compared = hashed.withColumn(
        "windows", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), sortable)
    ).drop("hashes")
    same = lambda w, k: F.coalesce(F.get("windows", k)["g"] == w["g"], F.lit(False))
    repeated = F.filter("windows", lambda w, k: same(w, k - 1) | same(w, k + 1))
    counted = compared.withColumn("at", F.array_sort(F.transform(repeated, lambda w: w["i"])))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-_SPAN).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(_SPAN), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    counts = counted.select(
        "row",
        "host",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    return counts.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def host_verdicts(measured: DataFrame) -> DataFrame:
    """host, documents, failed, failure_rate (shrunk) and rejected for every host of measured (host, base_failed).

    Failures of a host are taken as binomial with a rate from a beta distribution common to all hosts. Its mean is the
    pooled rate; its weight comes from the spread of the hosts' rates beyond what chance explains. Documents without a
    host belong to none.
    """
    hosts = (
        measured.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    )
    # Three sums over the hosts are all the driver sees.
    total = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("documents").alias("n"),
        F.sum("failed").alias("f"),
        F.sum(F.col("failed") * F.col("failed") / F.col("documents")).alias("square"),
    ).first()
    n, mean, low, high = total.n or 1, (total.f or 0) / (total.n or 1), *PRIOR_WEIGHT
    chance = mean * (1 - mean)
    spread = max(0.0, (total.square or 0.0) / n - mean * mean - chance * (total.hosts or 0) / n)
    weight = min(high, max(low, chance / spread - 1)) if spread > 0 else high
    a, b = mean * weight, (1 - mean) * weight
    rate = (F.col("failed") + F.lit(a)) / (F.col("documents") + F.lit(a + b))
    error = F.sqrt(F.col("failure_rate") * (1 - F.col("failure_rate")) / (F.col("documents") + F.lit(a + b + 1)))
    return hosts.withColumn("failure_rate", rate).withColumn(
        "rejected", F.col("failure_rate") - DEVIATIONS * error > MAX_HOST_RATE
    )


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of docs.

    docs has doc_id, text and the host column. Texts are read once and never shuffled: the small measured rows are
    stored, counted by host with partial sums, and joined with the verdicts, where adaptive execution splits a host that
    holds many rows. kept is false if the document fails a rule or its host is rejected.

    A null or empty text has no words and fails. A null host gives no verdict, so the document's own rules decide.
    Repeated rows count and are returned each by itself.
    """
    measured = stored(measures(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id")), host), "quality")
    verdicts = host_verdicts(measured).select("host", "rejected")
    return measured.join(verdicts, "host", "left").select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame, host: str = "source", broadcast_hosts: int = 50_000) -> DataFrame:
    """The rows of docs that pass their own rules and whose host is not rejected, with their columns unchanged.

    Only rows that pass are stored with their text. Rejected hosts are counted; up to `broadcast_hosts` names are
    broadcast, more are joined by shuffle, with the same result.
    """
    row = F.struct(*docs.columns)
    scored = measures(docs, row, host).select(F.when(~F.col("base_failed"), F.col("row")).alias("row"), "host", "base_failed")
    measured = stored(scored, "quality-rows")
    rejected = stored(host_verdicts(measured).where("rejected").select("host"), "rejected-hosts")
    n = rejected.count()
    passed = measured.where(~F.col("base_failed"))
    if n:
        passed = passed.join(F.broadcast(rejected) if n <= broadcast_hosts else rejected, "host", "left_anti")
    return passed.select("row.*")


#: The same result in DuckDB SQL; the constants are those above.
ORACLE = """
with texts as (
  select row_number() over () as k, doc_id, source, coalesce(text, '') as text from documents
), worded as (
  select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from texts
), windows as (
  select k, i, array_to_string(w[i:i + 4], ' ') as g
  from (select k, w, unnest(range(1, len(w) - 3)) as i from worded where len(w) > 5)
), repeated as (
  select k, i from (select *, count(*) over (partition by k, g) as c from windows) where c > 1
), covered as (
  select k, sum(least(5, i - before)) as n
  from (select k, i, lag(i, 1, -5) over (partition by k order by i) as before from repeated) group by k
), counted as (
  select doc_id, source, cast(len(w) as bigint) as n_words,
         cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(n, 0) as bigint) as n_repeat_words
  from worded left join covered using (k)
), judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted
), hosts as (
  select source, count(*) as n, count(*) filter (base_failed) as f from judged where source is not null group by source
), pooled as (
  select sum(n) as n, sum(f) / sum(n) as m, count(*) as h, sum(f * f / n) / sum(n) as square from hosts
), spread as (
  select *, m * (1 - m) as chance, greatest(0, square - m * m - m * (1 - m) * h / n) as s from pooled
), prior as (
  select m, case when s > 0 then least(10000.0, greatest(1.0, chance / s - 1)) else 10000.0 end as weight from spread
), rated as (
  select source, n, (f + m * weight) / (n + weight) as rate, weight from hosts, prior
), rejected as (
  select source from rated where rate - 1.645 * sqrt(rate * (1 - rate) / (n + weight + 1)) > 0.5
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and (source is null or source not in (select source from rejected)) as kept
from judged
"""
