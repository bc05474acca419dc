"""Secret scan through a trigram inverted index, with column expressions only.

From each rule's regex a Boolean trigram query is derived: alternatives of trigrams that a match must contain. Postings
(trigram, document) of those trigrams are intersected to candidates, and only candidates are searched with the regex.
Rules without a mandatory trigram search every text.

Places count code points, end exclusive. Defined cases: a null text is empty; a document without id is searched by every
rule; rows that repeat an id are searched each on their own; ``scan`` keeps other columns, but one named ``spans`` is replaced;
an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landstrata.session import scratch_path

SPACE = r"\x20\x09-\x0D"
GAP = "\0"
SPANS = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """``group`` (0: the match) has to hold at least ``least`` characters, else the match is dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The three base rules first; their order is the order of kinds at one place.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs of [0-9a-f]+ that are long enough: the same matches
)
RULES = BASE + (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("login", rf"://[^{SPACE}/:@]+:[^{SPACE}/@]+@"),
)


def _strings(nodes, most: int = 64) -> list[str]:
    """What the nodes can match, as strings in which GAP stands for anything; a gap replaces what has too many forms."""
    out = [""]
    for op, arg in nodes:
        if op is ops.LITERAL:
            forms = [chr(arg)]
        elif op is ops.IN and all(o is ops.LITERAL for o, _ in arg):
            forms = [chr(a) for _, a in arg]
        elif op is ops.SUBPATTERN:
            forms = _strings(arg[-1], most)
        elif op is ops.BRANCH:
            forms = [s for branch in arg[1] for s in _strings(branch, most)]
        elif op is ops.MAX_REPEAT and arg[1] == 1:
            forms = ["", *_strings(arg[2], most)] if arg[0] == 0 else _strings(arg[2], most)
        elif op is ops.MAX_REPEAT and arg[0]:
            forms = [s + GAP for s in _strings(arg[2], most)]
        else:
            forms = [GAP]
        out = [a + b for a, b in itertools.product(out, forms if len(out) * len(forms) <= most else [GAP])]
    return list(dict.fromkeys(out))


def trigram_query(regex: str) -> list[list[str]]:
    """Alternatives of lower-case trigrams; a match holds all of one alternative. Empty: no trigram is mandatory."""
    found = set()
    for s in _strings(parser.parse(regex)):
        found.add(frozenset(run[i:i + 3].lower() for run in s.split(GAP) for i in range(len(run) - 2)))
    if frozenset() in found:
        return []
    return sorted(sorted(a) for a in found if not any(b < a for b in found))


def postings(docs: DataFrame, rules=RULES, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index over all trigrams that the rules ask for: ``trigram, doc``."""
    asked = sorted({t for r in rules for alternative in trigram_query(r.regex) for t in alternative})
    folded = docs.select(F.col(doc).alias("doc"), F.lower(F.col(text)).alias("folded"))
    present = F.array(*[F.when(F.contains(F.col("folded"), F.lit(t)), F.lit(t)) for t in asked])
    return folded.select("doc", F.explode(F.array_compact(present)).alias("trigram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """``doc, kinds``: documents whose postings satisfy a rule's trigram query."""
    rows = [(t, r.kind, n, 1 << i, (1 << len(alternative)) - 1)
            for r in rules for n, alternative in enumerate(trigram_query(r.regex)) for i, t in enumerate(alternative)]
    values = ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', '{k}', {n}, {b}L, {m}L)" for t, k, n, b, m in rows)
    query = index.sparkSession.sql(f"SELECT * FROM VALUES {values} AS q(trigram, kind, alternative, bit, mask)")
    return (
        index.join(query, "trigram")
        .groupBy("doc", "kind", "alternative").agg(F.bit_or("bit").alias("bits"), F.first("mask").alias("mask"))
        .filter(F.col("bits") == F.col("mask"))
        .groupBy("doc").agg(F.collect_set("kind").alias("kinds"))
    )


def _matches(text: Column, rule: Rule, ordinal: int) -> Column:
    """Spans of one rule: lengths of what lies between matches and of the matches, summed up."""
    regex = F.lit(rule.regex)
    gaps = F.transform(F.split(text, rule.regex, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.length) if rule.group else whole
    lengths = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    spans = F.aggregate(
        F.filter(lengths, lambda x: x["whole"].isNotNull()),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["whole"]).alias("at"),
            F.when(x["value"] >= rule.least, F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("start"), F.lit(ordinal).alias("ord"),
                (acc["at"] + x["gap"] + x["whole"]).alias("end"), F.lit(rule.kind).alias("kind")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return F.when(F.rlike(text, regex), spans).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, rules=RULES, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (start, ord, end, kind) sorted by start, then order of the rules."""
    spark = docs.sparkSession
    path = scratch_path(spark, "secret-candidates")
    candidates(postings(docs, rules, doc, text), rules).write.parquet(path)
    key, asked_kinds = (next(f"_{n}{i}" for i in range(len(docs.columns) + 1) if f"_{n}{i}" not in docs.columns) for n in ("doc", "kinds"))
    found = spark.read.parquet(path).select(F.col("doc").alias(key), F.col("kinds").alias(asked_kinds))
    joined = docs.join(found, F.col(doc) == F.col(key), "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = []
    for i, rule in enumerate(rules):
        spans = _matches(whole, rule, i)
        if trigram_query(rule.regex):
            asked = F.col(doc).isNull() | F.coalesce(F.array_contains(asked_kinds, rule.kind), F.lit(False))
            spans = F.when(asked, spans).otherwise(F.array().cast(SPANS))
        parts.append(spans)
    return joined.withColumn("spans", F.sort_array(F.concat(*parts))).drop(key, asked_kinds)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""
    whole = F.coalesce(text, F.lit(""))
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when((s["start"] < acc["at"]) & (acc["at"] > 0), acc["out"]).otherwise(F.concat(
                acc["out"], F.substr(whole, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
            .alias("out")),
        lambda acc: F.concat(acc["out"], F.substr(whole, (acc["at"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
