"""Functions of file content and other long texts, as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv


def _content(content: Column | str | None) -> Column:
    if content is None:
        return F.col("content")
    return F.col(content) if isinstance(content, str) else content


def strip(text: Column) -> Column:
    """Without leading and trailing ASCII whitespace (linear, no regex)."""
    return F.trim(text, F.lit(fv.WHITESPACE))


# -- S2 ---------------------------------------------------------------------

def decode_text(raw: Column) -> Column:
    """Bytes to text: UTF-8, bad bytes dropped, line ends folded to ``\\n``."""
    text = F.make_valid_utf8(raw.cast("string"))
    text = F.replace(text, F.lit("�"), F.lit(""))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


# -- P11, P14 .. P16, A13 ---------------------------------------------------

def has_java_entry(content: Column | str | None = None) -> Column:
    c = _content(content)
    return c.contains(fv.BOOT_ANNOTATION) | c.rlike(fv.MAIN_METHOD)


def has_gradle_entry(content: Column | str | None = None) -> Column:
    c = _content(content)
    return c.rlike(fv.GRADLE_APPLY_APPLICATION) | c.rlike(fv.GRADLE_PLUGINS_APPLICATION)


def non_blank(content: Column | str | None = None) -> Column:
    """Not null and not only whitespace."""
    c = _content(content)
    return c.isNotNull() & c.rlike(r"\S")


def contains_any(
    patterns: Iterable[str], content: Column | str | None = None, case_sensitive: bool = True
) -> Column:
    """The patterns that occur in the content, in the given order."""
    c, patterns = _content(content), list(patterns)
    if not case_sensitive:
        c, patterns = F.lower(c), [p.lower() for p in patterns]
    hits = F.array_compact(F.array(*[F.when(c.contains(p), F.lit(p)) for p in patterns]))
    return F.coalesce(hits, F.array().cast("array<string>"))


def has_framework(language: Column, content: Column | str | None = None) -> Column:
    return (language == "Java") & F.coalesce(
        _content(content).contains(fv.BOOT_ANNOTATION), F.lit(False)
    )


def stereotype_annotations(content: Column | str | None = None) -> Column:
    return F.regexp_count(_content(content), F.lit(fv.STEREOTYPES))


def mapping_annotations(content: Column | str | None = None) -> Column:
    return F.regexp_count(_content(content), F.lit(fv.MAPPINGS))


# -- F3 ---------------------------------------------------------------------

def extract_patterns(patterns: dict[str, str], content: Column | str | None = None) -> Column:
    """All matches of each named regex; ``.`` also matches line ends.

    A pattern with no group yields whole matches, with one group that group.  The
    result is ``map<string, array<string>>``.  If any pattern has several groups it
    is a struct with one field per name, holding ``array<struct<_1, _2, ...>>`` for
    those patterns.
    """
    c = F.coalesce(_content(content), F.lit(""))
    matches, several = {}, False
    for name, pattern in patterns.items():
        groups = re.compile(pattern).groups
        regex = F.lit("(?s)" + pattern)
        if groups <= 1:
            matches[name] = F.regexp_extract_all(c, regex, F.lit(groups))
        else:
            several = True
            columns = [F.regexp_extract_all(c, regex, F.lit(g)) for g in range(1, groups + 1)]
            names = ", ".join(f"_{g}: string" for g in range(1, groups + 1))
            matches[name] = F.arrays_zip(*columns).cast(f"array<struct<{names}>>")
    if several:
        return F.struct(*[m.alias(n) for n, m in matches.items()])
    return F.map_from_arrays(F.array(*map(F.lit, matches)), F.array(*matches.values()))


# -- F4 .. F8 ---------------------------------------------------------------

def fold_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def extract_reasoning(text: Column) -> Column:
    """``struct<text, reasoning>``: HTML comments taken out of the text.

    A text without comments is left exactly as it is.
    """
    # no comment ends after the last closing mark: what follows is not searched again from
    # every opening mark in it
    tail = F.when(text.contains("-->"), F.substring_index(text, "-->", -1)).otherwise(text)
    head = F.left(text, F.length(text) - F.length(tail))

    def split(h: Column, found: Column) -> Column:
        without = F.concat(F.regexp_replace(h, fv.HTML_COMMENT, ""), tail)
        return F.struct(
            F.when(F.size(found) > 0, strip(fold_newlines(without))).otherwise(text).alias("text"),
            strip(F.array_join(found, "\n\n")).alias("reasoning"),
        )

    comments = F.lit(fv.HTML_COMMENT)
    return _with(
        head, lambda h: _with(F.regexp_extract_all(h, comments, F.lit(1)), lambda f: split(h, f))
    )


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_fence(text: Column) -> Column:
    """Inner text of a fenced document, up to its last fence; others unchanged."""
    fence = "```"
    # `start` and `end` count characters before the inner text and before the last fence
    start = F.when(text.startswith("```markdown"), F.locate("\n", text, 11)).otherwise(
        F.locate("\n", text, 4)
    )
    end = F.length(text) - F.instr(F.reverse(text), fence) - F.lit(2)
    fenced = text.startswith(fence) & F.substr(text, F.lit(4)).contains(fence)
    return F.when(
        fenced & (start > 0) & (end > start),
        strip(F.substr(text, start + 1, end - start)),
    ).otherwise(text)


def truncate(text: Column, limit: int, keep: int, tail: str) -> Column:
    """Texts over ``limit`` characters are cut to ``keep`` plus ``tail``."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit(tail))
    ).otherwise(text)


def parse_verdict(text: Column) -> Column:
    """True for a verdict to replace: by the last line, else by the whole text."""
    last = F.upper(strip(F.substring_index(strip(text), "\n", -1)))
    yes, no = last.contains("YES"), last.contains("NO")
    whole = F.upper(text)
    return (
        F.when(yes & ~no, F.lit(True))
        .when(no & ~yes, F.lit(False))
        .otherwise(whole.contains("YES") & whole.contains("SHOULD BE REPLACED"))
    )


# -- C9 ---------------------------------------------------------------------

def quality_signs(text: Column) -> dict[str, Column]:
    """Countable signs of a low-quality README: name -> boolean Column."""
    t = F.coalesce(text, F.lit(""))
    body = strip(t)
    signs = {name: t.rlike(pattern) for name, pattern in fv.QUALITY_SIGNS.items()}
    signs["very_short"] = F.length(body) < fv.MIN_README_CHARS
    signs["one_line"] = ~body.contains("\n")
    signs["only_a_link"] = t.rlike(fv.ONLY_A_LINK)
    return signs
