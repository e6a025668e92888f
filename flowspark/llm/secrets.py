"""Secret scans over a trigram index.

Each rule is a regular expression. ``trigram_query`` derives from it which trigrams every match must hold: an AND of
clauses, each an OR of strings whose trigrams must all occur. The index holds postings (trigram, text) of those trigrams;
postings of a text are intersected into the rules that may match it, and only these are run over it. A rule without
mandatory trigrams (hex runs) is run over every text. All of it is column functions, groupings and one join.

Cases: a null text is an empty one; a text without finds gives no spans and the digest of the empty string; repeated rows
are scanned alike; ids play no part in the search, so they may be null or repeated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

try:
    from re import _parser as parser  # the standard library's own reader of patterns
except ImportError:  # before Python 3.11
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` of a match must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The first three are the base rules; matches of "access" and "hex" that are too short can't hide longer ones, so the
# length stands in the pattern.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login_url", r"[a-z][a-z0-9+.-]{0,20}://[^\s/:@]{1,100}:[^\s/:@]{1,100}@"),
)
RULES = BASE + MORE
ENUMERATED = 64

#: AND of clauses; a clause is an OR of sets of trigrams that must all occur.
Query = tuple[tuple[frozenset[str], ...], ...]


def trigram_query(pattern: str) -> Query:
    """What trigrams of the lower-cased text every match of ``pattern`` needs; empty if none can be named."""
    clauses: list[tuple[frozenset[str], ...]] = []

    def close(strings: set[str]) -> None:
        if all(len(s) >= 3 for s in strings):
            clauses.append(tuple(sorted({frozenset(s[k:k + 3] for k in range(len(s) - 2)) for s in strings}, key=sorted)))

    def listed(op, value) -> set[str] | None:
        """All strings a part can match, lower-cased, if they are few."""
        name = str(op)
        if name == "LITERAL":
            return {chr(value).lower()}
        if name == "IN":
            if all(str(o) == "LITERAL" for o, _ in value):
                return {chr(v).lower() for _, v in value}
            return None
        if name == "SUBPATTERN":
            return joined(value[-1])
        if name == "BRANCH":
            parts = [joined(branch) for branch in value[1]]
            return None if None in parts else set().union(*parts)
        if name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1:
            inner = joined(value[2])
            return None if inner is None else inner | ({""} if value[0] == 0 else set())
        return None

    def joined(items) -> set[str] | None:
        strings = {""}
        for op, value in items:
            part = listed(op, value)
            if part is None or len(part) * len(strings) > ENUMERATED:
                return None
            strings = {a + b for a in strings for b in part}
        return strings

    def walk(items) -> None:
        run = {""}
        for op, value in items:
            part = listed(op, value)
            if part is not None and len(part) * len(run) <= ENUMERATED:
                run = {a + b for a in run for b in part}
                continue
            close(run)
            run = {""}
            if part is not None:
                run = part
            elif str(op) == "SUBPATTERN":
                walk(value[-1])
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
                walk(value[2])
        close(run)

    walk(parser.parse(pattern))
    return tuple(dict.fromkeys(clauses))


def candidates(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key`` and the kinds whose trigram query the text meets, for texts with any. Postings are built and intersected."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    wanted = sorted({gram for query in queries.values() for clause in query for grams in clause for gram in grams})
    if not wanted:
        return df.select(key, F.array().cast("array<string>").alias("may_match")).limit(0)
    lowered = df.select(F.col(key), F.lower(text).alias("lowered"))
    postings = lowered.select(key, F.explode(F.filter(
        F.array(*map(F.lit, wanted)), lambda gram: F.contains(F.col("lowered"), gram))).alias("gram"))
    lists = postings.groupBy(key).agg(F.collect_set("gram").alias("grams"))  # at most the trigrams of the rules
    holds = lambda grams: F.size(F.array_intersect("grams", F.array(*map(F.lit, sorted(grams))))) == len(grams)
    cases = []
    for kind, query in queries.items():
        if not query:
            continue
        test = F.lit(True)
        for clause in query:
            either = F.lit(False)
            for grams in clause:
                either = either | holds(grams)
            test = test & either
        cases.append(F.when(test, F.lit(kind)))
    return (lists.select(key, F.array_compact(F.array(*cases)).alias("may_match")).filter(F.size("may_match") > 0))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Matches, leftmost and not overlapping, as (start, order, kind, end); positions come from the pieces in between."""
    pattern = F.lit(rule.pattern)
    lengths = F.zip_with(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)),
                         lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size")))
    graded = F.zip_with(lengths, F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda length, part: F.struct(
        length["gap"].alias("gap"), length["size"].alias("size"), (F.length(part) >= rule.least).alias("ok")))
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    walked = F.aggregate(
        F.filter(graded, lambda m: m["size"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda state, m: F.struct(
            (state["at"] + m["gap"] + m["size"]).alias("at"),
            F.when(m["ok"], F.concat(state["found"], F.array(F.struct(
                (state["at"] + m["gap"]).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"),
                (state["at"] + m["gap"] + m["size"]).alias("end"))))).otherwise(state["found"]).alias("found")))
    return F.coalesce(walked["found"], empty)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with ``secret_spans``: array of (start, order, kind, end) in code points, by start, then rule order.

    A column of that name is replaced. Texts are joined with their candidates by a hash of id-free content and row
    columns; equal keys mean equal texts, so repeated rows get the same spans.
    """
    columns = [F.col(f"`{name}`") for name in df.columns if name != "secret_spans"]
    # A copy group of any size is spread by the other columns of its rows.
    spread = [F.col(f"`{name}`") for name, kind in df.dtypes if name != text and not kind.startswith(("map", "array<map"))]
    keyed = df.select(F.struct(*columns).alias("row"), F.xxhash64(F.col(text), *spread).alias("__key"))
    searched = df.select(F.xxhash64(F.col(text), *spread).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    found = candidates(searched, "__key", "__text", rules)
    joined, value = keyed.join(found, "__key", "left"), F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    parts = []
    for order, rule in enumerate(rules):
        spans = _spans(value, rule, order)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains("may_match", rule.kind), spans)
        else:
            spans = F.when(value.rlike(rule.pattern), spans)
        parts.append(F.coalesce(spans, F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")))
    return joined.select("row.*", F.sort_array(F.concat(*parts)).alias("secret_spans"))


def redacted(df: DataFrame, text: str = "text", mark: str = "[{kind}]") -> DataFrame:
    """``df`` (from ``scan``) with every span replaced by its mark; overlapping spans are covered by one mark."""
    cut = F.aggregate(
        "secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda state, s: F.when(s["start"] >= state["at"], F.struct(
            s["end"].alias("at"), F.concat(
                state["out"], F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"]),
                F.replace(F.lit(mark), F.lit("{kind}"), s["kind"])).alias("out")))
        .otherwise(F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))))
    whole = F.when(F.size("secret_spans") > 0, F.concat(
        cut["out"], F.substring(F.col(text), cut["at"] + 1, F.length(text)))).otherwise(F.col(text))
    return df.withColumn(text, whole)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["order"] < len(BASE))
    return found.select("doc_id", *[of(rule.kind).alias(f"n_{rule.kind}") for rule in BASE],
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secret_spans")).alias("spans"))


def _oracle() -> str:
    parts = []
    for order, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
          SELECT doc_id, {order} AS rank, '{rule.kind}' AS kind,
            coalesce(list_sum(list_transform(pieces[1:k], lambda p: length(p))), 0)
              + coalesce(list_sum(list_transform(whole[1:k - 1], lambda p: length(p))), 0) AS s,
            length(whole[k]) AS size, length(part[k]) AS part_size
          FROM (SELECT doc_id, pieces, whole, part, unnest(range(1, len(whole) + 1)) AS k
                FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS pieces,
                        regexp_extract_all(t, '{pattern}') AS whole,
                        regexp_extract_all(t, '{pattern}', {rule.group}) AS part
                      FROM texts WHERE regexp_matches(t, '{pattern}')))
          WHERE length(part[k]) >= {rule.least}""")
    spans = " UNION ALL ".join(parts)
    of = ", ".join(f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in BASE)
    return f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        spans AS ({spans}),
        named AS (SELECT *, kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT AS span FROM spans),
        per AS (SELECT doc_id, {of},
                  coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}), '') AS base,
                  coalesce(string_agg(span, ',' ORDER BY s, rank), '') AS spans
                FROM named GROUP BY doc_id)
        SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0)::BIGINT AS n_{rule.kind}" for rule in BASE)},
          sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM texts LEFT JOIN per USING (doc_id)"""


SQL = _oracle()
