"""Small text builders, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv


# -- F13 .. F15, F17 --------------------------------------------------------

def watermark(text: Column, date: Column | str, model: Column | str) -> Column:
    """Text with a closing heading, date and model. The date is an argument, so runs repeat."""
    date = F.lit(date) if isinstance(date, str) else F.date_format(date, "yyyy-MM-dd")
    model = F.lit(model) if isinstance(model, str) else model
    return F.concat(
        text, F.lit(f"\n\n{fv.WATERMARK_HEADING}\nGenerated on "), date,
        F.lit(" | Model: "), model,
    )


def bullet(item: Column) -> Column:
    return F.concat(F.lit("- "), item)


def bullet_lines(items: Column, default: str) -> Column:
    """One ``- x`` line per element of the array, or the default text."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, bullet), "\n")).otherwise(
        F.lit(default)
    )


def fenced_block(path: Column, content: Column) -> Column:
    return F.concat(
        F.lit("### "), path, F.lit("\n```\n"), content, F.lit("\n```\n\n")
    )


def flag_sentence(flag: Column, sentence: str) -> Column:
    return F.when(flag, F.lit(sentence)).otherwise(F.lit(""))


# -- R11 --------------------------------------------------------------------

def cap_with_overflow(items: Column, n: int, fmt: str) -> Column:
    """First ``n`` elements and, if there are more, one line made with ``fmt`` (a ``%d``)."""
    more = F.format_string(fmt, F.size(items) - F.lit(n))
    return F.when(
        F.size(items) > n, F.concat(F.slice(items, 1, n), F.array(more))
    ).otherwise(items)


# -- F16 --------------------------------------------------------------------

def render_template(template: Column | str, slots: dict[str, Column]) -> Column:
    """Replace ``${name}`` by each slot in turn; a null slot becomes empty.

    The replacements run one after the other, so a placeholder inside an inserted
    text is replaced too when its turn comes later.
    """
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in slots.items():
        out = F.replace(out, F.lit("${" + name + "}"), F.coalesce(value, F.lit("")))
    return out


# -- K6 ---------------------------------------------------------------------

def artifact_name(kind: str, repo: Column, step: Column, model: str) -> Column:
    """File name of a saved artifact.

    ``kind`` is ``output``, ``context``, ``prompt``, ``reasoning``, ``profile``,
    ``final``, ``final_reasoning`` or ``step``.
    """
    name = F
    for number, step_name in fv.STEP_NAMES.items():
        name = name.when(step == number, F.lit(step_name))
    name = name.otherwise(F.concat(F.lit("step-"), step.cast("string")))
    m, n = F.lit(model), step.cast("int")
    if kind == "step":
        return F.format_string("step_%02d_output.md", n)
    if kind == "output":
        return F.format_string("step_%02d_%s_output_%s_%s.md", n, name, repo, m)
    if kind in ("context", "prompt", "reasoning"):
        ending = {"context": "json", "prompt": "log", "reasoning": "md"}[kind]
        return F.format_string(f"%s_step%d_%s_{kind}_%s.{ending}", repo, n, name, m)
    if kind == "profile":
        return F.format_string("%s_repo_context_%s.json", repo, m)
    if kind == "final":
        return F.concat(repo, F.lit("_ai.README.md"))
    if kind == "final_reasoning":
        return F.concat(repo, F.lit("_reasoning.md"))
    raise ValueError(f"unknown artifact kind {kind!r}")
