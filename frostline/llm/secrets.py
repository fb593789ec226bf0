"""Secret scans over a trigram inverted index: Boolean trigram queries from each rule, postings intersected, verified.

DataFrame functions only; the rules' patterns are read on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: The three base kinds, in the order in which equal starts are listed.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Public formats of keys and tokens that the method adds.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
RULES = BASE + ADDED
MASK = "[secret]"
_MOST_VARIANTS = 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The trigrams (lower case) every match must hold, as alternatives; empty if a match may hold none.

    The pattern is followed as sequences of literal runs: a branch, an optional part or a small character class gives
    variants, everything else ends a run.
    """
    found = {_trigrams(runs) for runs in _variants(re._parser.parse(pattern), [("",)])}
    if frozenset() in found:
        return []
    return sorted((f for f in found if not any(other < f for other in found)), key=sorted)


def _trigrams(runs: tuple[str, ...]) -> frozenset[str]:
    return frozenset(run[i : i + 3] for run in map(str.lower, runs) for i in range(len(run) - 2))


def _variants(nodes, before: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The runs in `before`, each continued in every way through the nodes; the last run of each is still open."""
    for op, value in nodes:
        kind, options = str(op), None
        if kind == "LITERAL":
            options = [(chr(value),)]
        elif kind == "SUBPATTERN":
            options = _variants(value[-1], [("",)])
        elif kind == "BRANCH":
            options = [v for branch in value[1] for v in _variants(branch, [("",)])]
        elif kind == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 5:
            options = [(chr(c),) for _, c in value]
        elif kind == "MAX_REPEAT":
            least, most, sub = value
            if (least, most) == (0, 1):
                options = [("",), *_variants(sub, [("",)])]
            elif least:
                options = [(*v, "") for v in _variants(sub, [("",)])]
        if options is None or len(options) * len(before) > _MOST_VARIANTS:
            options = [("", "")]
        before = [(*a[:-1], a[-1] + b[0], *b[1:]) for a, b in product(before, dict.fromkeys(options))]
    return before


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, text_key: the inverted index of the given trigrams over all texts, equal texts once.

    text_key is a hash of the text. Texts that share one by chance share candidates, which the patterns then decide.
    """
    low = docs.select(F.xxhash64("text").alias("text_key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select(F.explode(held).alias("trigram"), "text_key").distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """text_key, rules (a bit for each rule whose query the text satisfies), from the postings."""
    rows = []
    for r, rule in enumerate(rules):
        for a, alternative in enumerate(trigram_query(rule.pattern)):
            full = (1 << len(alternative)) - 1
            rows += [(t, r, a, 1 << i, full) for i, t in enumerate(sorted(alternative))]
    terms = ", ".join(f"('{t}', {r}, {a}, {bit}L, {full}L)" for t, r, a, bit, full in rows)
    query = index.sparkSession.sql(f"select * from values {terms} as q(trigram, rule, alternative, bit, needed)")
    met = (
        index.join(F.broadcast(query), "trigram")  # a row per trigram of the rules
        .groupBy("text_key", "rule", "alternative")
        .agg(F.bit_or("bit").alias("bits"), F.first("needed").alias("needed"))
        .where("bits = needed")
    )
    return met.groupBy("text_key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _matches(rule: Rule, order: int) -> Column:
    """The spans of a rule in column text: leftmost, non-overlapping, in code points, too short ones dropped."""
    pattern = F.lit(rule.java)
    at = F.aggregate(
        F.arrays_zip(
            F.split("text", rule.java, -1).alias("before"),
            F.regexp_extract_all("text", pattern, F.lit(0)).alias("match"),
            F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("part"),
        ),
        F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("found")),
        lambda s, m: F.struct(
            (s["pos"] + F.length(m["before"]) + F.coalesce(F.length(m["match"]), F.lit(0))).alias("pos"),
            F.when(
                F.length(m["part"]) >= rule.least,
                F.concat(
                    s["found"],
                    F.array(
                        F.struct(
                            (s["pos"] + F.length(m["before"])).alias("start"),
                            F.lit(order).alias("kind_order"),
                            (s["pos"] + F.length(m["before"]) + F.length(m["match"])).alias("end"),
                            F.lit(rule.kind).alias("kind"),
                        )
                    ),
                ),
            )
            .otherwise(s["found"])
            .alias("found"),
        ),
        lambda s: s["found"],
    )
    return F.when(F.rlike("text", pattern), at).otherwise(F.array().cast(f"array<{_SPAN}>"))


_SPAN = "struct<start:int,kind_order:int,end:int,kind:string>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = 500_000) -> DataFrame:
    """All columns of docs as struct `row`, text (null: empty) and spans, sorted by start and kind.

    The index holds the trigrams that the rules need. A rule is tried only on texts whose postings satisfy its query;
    rules without mandatory trigrams are tried on every text. Candidates (16 bytes each) are stored and counted: up to
    `broadcast_rows` are broadcast, so texts stay where they are; more are joined by shuffle, with the same result.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for alternative in q for t in alternative})
    found = stored(candidates(stored(postings(docs, trigrams), "trigrams"), rules), "secret-candidates")
    n = found.count()
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_key")
    )
    joined = keyed.join(F.broadcast(found) if n <= broadcast_rows else found, "text_key", "left")
    wanted = lambda r: F.coalesce(F.getbit("rules", F.lit(r)) == 1, F.lit(False))
    none = F.array().cast(f"array<{_SPAN}>")
    spans = [
        F.when(wanted(r), _matches(rule, r)).otherwise(none) if queries[r] else _matches(rule, r)
        for r, rule in enumerate(rules)
    ]
    return joined.select("row", "text", F.array_sort(F.concat(*spans)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of docs (doc_id, text).

    spans lists kind:start:end of all kinds; base_sha256 is the SHA-256 of the same list of the three base kinds. A null
    text is empty. Repeated rows are scanned like any other; texts that are equal share their index entries.
    """
    found = find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_order"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind_order"] < len(BASE))
    return found.select(
        "row.doc_id",
        *(count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def mask_secrets(docs: DataFrame, mask: str = MASK, length_column: str | None = None) -> DataFrame:
    """docs with every secret in the text replaced by the mask; all other columns and rows stay as they are.

    length_column, if given, gets the new number of characters of the texts that change.
    """
    found = find_secrets(docs)
    masked = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["pos"], x["end"]).alias("pos"),
            F.when(
                x["start"] >= s["pos"],
                F.concat(s["out"], F.substring("text", s["pos"] + 1, x["start"] - s["pos"]), F.lit(mask)),
            )
            .otherwise(s["out"])
            .alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring("text", s["pos"] + 1, F.length("text"))),
    )
    changed = found.select("row", F.when(F.size("spans") > 0, masked).alias("masked"))
    new = {"text": F.coalesce("masked", F.col("row.text"))}
    if length_column:
        old = F.col("row")[length_column]
        new[length_column] = F.coalesce(F.length("masked").cast(docs.schema[length_column].dataType), old)
    return changed.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
