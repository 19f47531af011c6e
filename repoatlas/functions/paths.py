"""Predicates and parts of relative paths, as Columns.

Every function takes the path as a Column (default ``col("path")``) and stays
inside whole-stage codegen: ``endswith``, ``contains`` and ``isin`` instead of
regexes wherever the rule allows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv


def _path(path: Column | str | None) -> Column:
    return F.col("path") if path is None else F.col(path) if isinstance(path, str) else path


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of the conditions, false for none."""
    conditions = list(conditions)
    return reduce(or_, conditions) if conditions else F.lit(False)


# From this many words on, one regex takes the place of a chain of string tests: the method
# Spark generates for a scan must stay under the size the JVM still compiles (8000 bytes).
REGEX_FROM = 5


def contains_one(text: Column, words: Iterable[str]) -> Column:
    """True if one of the words is in the text; words that hold another one are not tested."""
    words = list(dict.fromkeys(words))
    words = [w for w in words if not any(o in w for o in words if o != w)]
    if len(words) >= REGEX_FROM:
        return text.rlike("|".join(map(re.escape, words)))
    return any_of(text.contains(w) for w in words)


def ends_with_one(text: Column, suffixes: Iterable[str]) -> Column:
    """True if the text ends with one of the suffixes; the longer of two alike is not tested."""
    suffixes = list(dict.fromkeys(suffixes))
    suffixes = [s for s in suffixes if not any(s.endswith(o) for o in suffixes if o != s)]
    if len(suffixes) >= REGEX_FROM:
        return text.rlike("(?:" + "|".join(map(re.escape, suffixes)) + r")\z")
    return any_of(text.endswith(s) for s in suffixes)


# -- F2 ---------------------------------------------------------------------

def file_name(path: Column | str | None = None) -> Column:
    """Last segment of the path."""
    return F.substring_index(_path(path), "/", -1)


def directory(path: Column | str | None = None) -> Column:
    """Everything before the last ``/``; empty for a root file."""
    p = _path(path)
    return F.left(p, F.greatest(F.length(p) - F.length(file_name(p)) - 1, F.lit(0)))


def suffix(path: Column | str | None = None) -> Column:
    """Lower-case last suffix with its dot; empty for ``.env``, ``foo.`` or no dot."""
    name = file_name(F.lower(_path(path)))
    last = F.substring_index(name, ".", -1)
    return F.when(
        (last != "") & (F.length(name) > F.length(last) + 1), F.concat(F.lit("."), last)
    ).otherwise(F.lit(""))


def relative_path(full: Column, root: Column) -> Column:
    """``full`` without the leading ``root`` and its slash."""
    base = F.rtrim(root, F.lit("/"))
    return F.substr(full, F.length(base) + 2)


# -- P1 ---------------------------------------------------------------------

def in_excluded_dir(
    path: Column | str | None = None,
    dirs: Iterable[str] = fv.EXCLUDED_DIRS,
    match: str = "segment",
) -> Column:
    """True below an excluded directory.

    ``match='segment'`` compares whole directory names; ``'substring'`` accepts the
    name anywhere in the directory part.  The default list has `lemma` in it, a name that
    other corpora may use for ordinary folders: pass ``dirs`` without it there.
    """
    dirs = list(dirs)
    if match == "segment":
        # a directory name is a segment with a slash on both sides
        return contains_one(F.concat(F.lit("/"), _path(path)), [f"/{x}/" for x in dirs])
    if match == "substring":
        return contains_one(directory(path), dirs)
    raise ValueError(f"match must be 'segment' or 'substring', not {match!r}")


# -- P2, P3 -----------------------------------------------------------------

def _rules(analyzer):
    # a record of language rules, or the name of a built-in one; the records are made of
    # functions of this module, so they are looked up late
    from repoatlas.functions.languages import rules_of

    return rules_of(analyzer)


def is_analyzable(
    analyzer, path: Column | str | None = None, readme_md: bool = True
) -> Column:
    """Shell script, example configuration, or one of the analyzer's extensions.

    ``analyzer`` is a `languages.LanguageRules` or the name of a built-in one.

    ``readme_md`` also lets nested ``readme.md`` files in.
    """
    p = _path(path)
    keep = is_shell(p) | is_example_config(p) | ends_with_one(p, _rules(analyzer).extensions)
    return keep | is_readme(p) if readme_md else keep


def is_key_file(analyzer, path: Column | str | None = None) -> Column:
    """Root file with one of the common or the analyzer's key names."""
    return _path(path).isin([*fv.COMMON_KEY_FILES, *_rules(analyzer).key_files])


def is_candidate(path: Column | str | None = None, languages=None) -> Column:
    """Key or analyzable for at least one analyzer: no other file is ever gathered.

    ``languages`` are the records in use, by default the built-in ones.
    """
    from repoatlas.functions.languages import BUILT_IN

    p = _path(path)
    languages = BUILT_IN if languages is None else languages
    names = {name for rules in languages for name in rules.key_files}
    extensions = {ext for rules in languages for ext in [".sh", *rules.extensions]}
    return (
        p.isin(sorted(names | set(fv.COMMON_KEY_FILES)))
        | is_example_config(p)
        | ends_with_one(p, sorted(extensions))
        | is_readme(p)
    ) & ~in_excluded_dir(p)


# -- P4 .. P10 --------------------------------------------------------------

def is_sonar(path: Column | str | None = None) -> Column:
    return contains_one(F.lower(_path(path)), fv.SONAR_MARKERS)


def is_ci_file(path: Column | str | None = None) -> Column:
    return _path(path) == fv.CI_FILE


def is_config(path: Column | str | None = None) -> Column:
    p = F.lower(_path(path))
    return (
        contains_one(p, fv.SONAR_MARKERS)
        | p.endswith(".sh")
        | ends_with_one(p, fv.CONFIG_EXTENSIONS)
        | ends_with_one(p, fv.CONFIG_EXAMPLE_SUFFIXES)
        | contains_one(p, fv.CONFIG_KEYWORDS)
    )


def is_config_lite(path: Column | str | None = None) -> Column:
    p = F.lower(_path(path))
    return ends_with_one(p, fv.CONFIG_LITE_EXTENSIONS) | contains_one(p, fv.CONFIG_LITE_KEYWORDS)


def is_shell(path: Column | str | None = None) -> Column:
    return _path(path).endswith(".sh")


def is_root_shell(path: Column | str | None = None) -> Column:
    p = _path(path)
    return p.endswith(".sh") & ~p.contains("/") & ~p.contains("\\")


def is_example_config(path: Column | str | None = None, on: str = "path") -> Column:
    """Example or template of a configuration file, by path or by name only."""
    if on not in ("path", "name"):
        raise ValueError(f"on must be 'path' or 'name', not {on!r}")
    p = F.lower(_path(path) if on == "path" else file_name(path))
    return contains_one(p, fv.EXAMPLE_MARKERS) & contains_one(p, fv.EXAMPLE_WORDS)


def is_special_config(path: Column | str | None = None) -> Column:
    return contains_one(F.lower(_path(path)), fv.SPECIAL_CONFIG_NAMES)


# -- P12, P13 ---------------------------------------------------------------

def is_readme(path: Column | str | None = None) -> Column:
    return F.lower(_path(path)).endswith("readme.md")


def is_original_readme(path: Column | str | None = None) -> Column:
    p = F.lower(_path(path))
    return p.isin(fv.README_NAMES) | p.endswith("/readme.md")


# -- F1 ---------------------------------------------------------------------

def detect_language(analyzer, path: Column | str | None = None) -> Column:
    """Language of the path by the analyzer's suffix table, else ``Unknown``."""
    return language_of_suffix(analyzer, suffix(path))


def language_of_suffix(analyzer, suffix_column: Column) -> Column:
    pairs = [F.lit(x) for pair in _rules(analyzer).languages.items() for x in pair]
    if not pairs:
        return F.lit(fv.UNKNOWN_LANGUAGE)
    return F.coalesce(
        F.element_at(F.create_map(*pairs), suffix_column), F.lit(fv.UNKNOWN_LANGUAGE)
    )


# -- J5 ---------------------------------------------------------------------

def key_file_category(path: Column | str | None = None) -> Column:
    """``example``, ``config`` or ``other``, for key files."""
    p = _path(path)
    return (
        F.when(contains_one(F.lower(p), fv.EXAMPLE_MARKERS), F.lit("example"))
        .when(ends_with_one(p, [".properties", ".yml", ".yaml"]), F.lit("config"))
        .otherwise(F.lit("other"))
    )


# -- F12 --------------------------------------------------------------------

def script_command(path: Column | str | None = None) -> Column:
    """``struct<kind, command>`` of a root shell script, null for any other file."""
    p = _path(path)
    name = F.lower(p)
    kind = (
        F.when(name.contains("start"), F.lit("run"))
        .when(name.contains("stop"), F.lit("stop"))
        .when(name.contains("run"), F.lit("run"))
    )
    return F.when(
        is_root_shell(p) & kind.isNotNull(),
        F.struct(kind.alias("kind"), F.concat(F.lit("./"), p).alias("command")),
    )


#: Above every score: falling scores as rising numbers of one width.
_TOP_SCORE = 10**12


def score_order(score: Column, order: Column) -> Column:
    """Sort key of a file within its repo: highest score first, then ``order``."""
    return F.concat(F.lpad((F.lit(_TOP_SCORE) - score).cast("string"), 13, "0"), order)


def discovery_order(is_key: Column, path: Column | str | None = None) -> Column:
    """Sort key of a file within its repo: key files first, then by path."""
    return F.concat(F.when(is_key, F.lit("0")).otherwise(F.lit("1")), _path(path))
