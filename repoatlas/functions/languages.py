"""What an analyzer knows of its language, as records that a caller can add to or replace.

A record is plain lists and functions that return Columns, so the rules of all languages are
compiled into the one scan of the corpus: no code per row, whatever a caller adds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.functions import score as fs


@dataclass(frozen=True)
class LanguageRules:
    """Rules of one analyzer.

    ``markers``      paths or folders at the root of a repo by which the analyzer is chosen
    ``extensions``   ends of the paths that are gathered
    ``key_files``    names at the root that are key files, besides those common to all
    ``languages``    lower-case suffix -> name of the language
    ``features``     new columns of the scan: name -> function of the content, which is empty
                     for a missing one. Only these functions see the content
    ``entry_point``  function of the file's language; its Column is true for an entry point.
                     Key files and files that are not gathered are never one
    ``score``        Column of points, added to those for entry points and key files
    ``lists``        further path lists of a repo: name -> condition on a gathered file
    ``facts``        further facts of a repo: name -> aggregate over its gathered files
    ``overview``     text of the overview part of the report

    Columns of ``entry_point``, ``score``, ``lists`` and ``facts`` may use ``path``, ``size``,
    ``suffix`` and all features, those of the built-in scan (`score.content_features`) too;
    ``lists`` and ``facts`` also the flags and the score of a file, but no ``suffix``.
    """

    name: str
    markers: Sequence[str] = ()
    extensions: Sequence[str] = ()
    key_files: Sequence[str] = ()
    languages: Mapping[str, str] = field(default_factory=dict)
    features: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)
    entry_point: Callable[[Column], Column] | None = None
    score: Callable[[], Column] | None = None
    lists: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    facts: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    overview: str = fv.NO_ANALYSIS


def _java_entry(language: Column) -> Column:
    gradle = (language == "Gradle") | F.lower(F.col("path")).contains("gradle")
    return F.when(language == "Java", F.col("has_java_entry")).otherwise(
        gradle & F.col("has_gradle_entry")
    )


def _is_language(name: str) -> Callable[[], Column]:
    return lambda: F.col("language") == name


def _built_in(name: str, **more) -> LanguageRules:
    return LanguageRules(
        name, fv.MARKERS[name], fv.EXTENSIONS[name], fv.KEY_FILES[name], fv.LANGUAGES[name], **more
    )


JAVA = _built_in(
    "java", entry_point=_java_entry, score=fs.java_points,
    lists={
        "java_files": _is_language("Java"),
        "gradle_files": lambda: (F.col("language") == "Gradle") | F.col("path").endswith(".gradle"),
    },
)
PYTHON = _built_in(
    "python", lists={"python_files": _is_language("Python")}, overview=fv.PYTHON_ANALYSIS
)
JAVASCRIPT = _built_in("javascript", overview=fv.JAVASCRIPT_ANALYSIS)

#: In the order they are tried; the default analyzer is named separately.
BUILT_IN = (JAVA, PYTHON, JAVASCRIPT)


def by_name(languages: Sequence[LanguageRules]) -> dict[str, LanguageRules]:
    """The records by name; two of one name, or two that add the same column, are an error."""
    out = {rules.name: rules for rules in languages}
    if len(out) < len(languages) or "auto" in out or not out:
        raise ValueError("languages need names of their own other than 'auto', one at least")
    taken = [*fs.content_features(), *(f for rules in languages for f in rules.features)]
    if len(set(taken)) < len(taken):
        raise ValueError("two languages have a feature of the same name, or a built-in one's")
    return out


def rules_of(analyzer: str | LanguageRules) -> LanguageRules:
    """The record itself, or the built-in one of that name."""
    if isinstance(analyzer, LanguageRules):
        return analyzer
    return by_name(BUILT_IN)[analyzer]
