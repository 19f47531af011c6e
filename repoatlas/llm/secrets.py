"""Secret scan with a trigram index: only documents that can match a rule are searched for it.

From each rule's regular expression follows a Boolean query on trigrams: any text the rule
matches holds all trigrams of at least one alternative of every clause. The index lists, for
each trigram that a rule needs, the documents that hold it; the postings of a rule are
intersected, and only the documents left are searched with the regular expression. A rule
without mandatory trigrams is searched in all documents.

Only DataFrame functions are used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import fresh

#: Alternatives of one clause; a clause with more is left out of the query.
MOST_STRINGS = 24
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched leftmost, without overlaps; matches whose ``group`` has fewer
    than ``least`` characters are dropped. ``quick``, if given, is found in every text that
    has such a match and is cheaper to look for."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    quick: str = ""


#: Patterns of the three kinds asked for, then of well-known key formats.
RULES = (
    Rule("assign",
         r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
BASE = ("assign", "access", "hex")


def _strings(item) -> list[str] | None:
    """All strings (in lower case) an element of a parsed pattern matches, if they are few."""
    op, arg = item
    name = str(op)
    if name == "LITERAL":
        return [chr(arg).lower()]
    if name == "IN":
        out: list[str] = []
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.append(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 4:
                out += [chr(c).lower() for c in range(value[0], value[1] + 1)]
            else:
                return None
        return sorted(set(out)) if len(out) <= 6 else None
    if name == "SUBPATTERN":
        return _joined(arg[3])
    if name == "BRANCH":
        found = [_joined(x) for x in arg[1]]
        return None if None in found else sorted({s for x in found for s in x})
    if name == "MAX_REPEAT" and arg[:2] == (0, 1):
        inside = _joined(arg[2])
        return None if inside is None else ["", *inside]
    return None


def _joined(items) -> list[str] | None:
    out = [""]
    for item in items:
        more = _strings(item)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = [a + b for a, b in product(out, more)]
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that all must hold; of a clause, all trigrams of one alternative must occur."""
    clauses: list[list[frozenset[str]]] = []
    run = [""]

    def close() -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() not in sets:
            least = [s for s in sets if not any(other < s for other in sets)]
            clauses.append(sorted(least, key=sorted))

    for item in re._parser.parse(pattern):
        more = _strings(item)
        if more is None or len(run) * len(more) > MOST_STRINGS:
            close()
            run = more if more and len(more) <= MOST_STRINGS else [""]
        else:
            run = [a + b for a, b in product(run, more)]
    close()
    return clauses


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``trigram, doc_id`` of the trigrams that the rules need, in lower case."""
    needed = sorted({t for r in rules for c in trigram_query(r.pattern) for s in c for t in s})
    text = F.col("_lower")
    there = F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in needed]))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("_lower")
    ).select("doc_id", F.explode(there).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``kinds``: the rules whose trigram query the document's postings satisfy."""
    held = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("_held"))
    kinds = []
    for rule in rules:
        if clauses := trigram_query(rule.pattern):
            hit = reduce(and_, [
                reduce(or_, [
                    reduce(and_, [F.array_contains("_held", t) for t in sorted(s)]) for s in clause
                ]) for clause in clauses
            ])
            kinds.append(F.when(hit, F.lit(rule.kind)))
    kinds = F.array_compact(F.array(*kinds)) if kinds else F.array().cast("array<string>")
    return held.select("doc_id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in code points, end exclusive.

    What ``split`` leaves lies between the matches that ``regexp_extract_all`` gives, so the
    lengths of both, added up, are the places.
    """
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length).alias("own"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        first = acc.at + p["gap"]
        last = first + p["size"]
        span = F.struct(
            first.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
            last.alias("end"),
        )
        kept = p["own"] >= rule.least
        return F.struct(
            F.coalesce(last, acc.at).alias("at"),
            F.when(kept, F.concat(acc.out, F.array(span))).otherwise(acc.out).cast(SPANS).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc.out)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """The rows of ``docs`` with ``secret_spans`` (or ``out``): start, rank and kind of rule, end; in this order.

    A null text is empty. Rows with the same id are each searched; rows with a null id, which
    may be many, meet no candidates and are searched for every rule. An empty table gives an
    empty result. A column of that name is replaced, any other columns are kept.
    """
    docs = docs.drop(out)
    own_id, own_kinds = fresh([*docs.columns, out], "_found_id", "_kinds")
    named = docs.filter(F.col(id_col).isNotNull())
    found = candidates(trigram_index(named, rules, id_col, text_col), rules)
    found = found.select(F.col("doc_id").alias(own_id), F.col("kinds").alias(own_kinds))
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    for rank, rule in enumerate(rules):
        near = F.array_contains(own_kinds, rule.kind) if trigram_query(rule.pattern) else F.lit(True)
        if rule.quick:
            near = near & text.rlike(rule.quick)
        parts.append(F.when(near, rule_spans(text, rule, rank)).otherwise(F.array().cast(SPANS)))
    joined = named.join(found.hint("shuffle_hash"), named[id_col] == found[own_id], "left")
    every = F.array(*[F.lit(rule.kind) for rule in rules])
    nameless = docs.filter(F.col(id_col).isNull()).withColumn(own_kinds, every)
    joined = joined.drop(own_id).unionByName(nameless)
    spans = F.sort_array(F.concat(*parts))
    return joined.withColumn(out, spans).select(*docs.columns, out)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", spans: str = "secret_spans") -> DataFrame:
    """The text with ``mark`` in place of every span of ``spans``; overlaps count as one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substr(text, acc.at + 1, s.start - acc.at)
        more = F.when(s.start < acc.at, F.array().cast("array<string>"))
        more = more.when((s.start == acc.at) & (acc.at > 0), F.array(F.lit("")))
        more = more.otherwise(F.array(piece, F.lit(mark)))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.concat(acc.out, more).alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc.out, ""), F.substr(text, acc.at + 1, F.char_length(text)))

    changed = F.aggregate(spans, start, step, end)
    return df.withColumn(text_col, F.when(F.size(spans) > 0, changed).otherwise(F.col(text_col)))
