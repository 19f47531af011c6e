"""Prompts, step planning and final texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.functions import content as fc
from repoatlas.functions import text as ft
from repoatlas.functions.batches import batches_of, give_back, rows_of
from repoatlas.functions.stream_text import PIECE, SlotValues, evenly, folded, replaced
from repoatlas.operators.aggregate import last_completed_step
from repoatlas.plans.profile import Corpus


# -- M7 ---------------------------------------------------------------------

def default_steps(spark: SparkSession) -> DataFrame:
    """``step, name, template`` with the built-in templates."""
    rows = [(n, fv.STEP_NAMES[n], t) for n, t in fv.STEP_TEMPLATES.items()]
    return spark.createDataFrame(rows, "step int, name string, template string")


# -- C10 --------------------------------------------------------------------

def _item(step: int, slot: str, text: Column, order: Column | None = None) -> Column:
    """One slot item as a struct."""
    return F.struct(
        F.lit(step).alias("step"), F.lit(slot).alias("slot"),
        (F.lit("") if order is None else order).alias("ord"), text.alias("text"),
    )


def _slots(rows: DataFrame, items: list[Column]) -> DataFrame:
    """Slot rows of the items of each row; null items drop out."""
    return rows.select("repo", F.explode(F.array_compact(F.array(*items))).alias("s")).select(
        "repo", "s.*"
    )


def _shared_items(step: int) -> list[Column]:
    """Items every template may ask for."""
    system = F.coalesce("type", F.lit("unknown"))
    values = {
        "name": F.col("repo"),
        "language": F.col("primary_language"),
        "is_spring_boot": ft.flag_sentence(F.col("has_spring_boot"), fv.SPRING_BOOT_SENTENCE),
        "build_system": system if step == 4 else F.concat(F.lit("Build System: "), system),
    }
    return [_item(step, slot, text) for slot, text in values.items()]


def profile_slots(profile: DataFrame) -> DataFrame:
    """Slot items of all steps that come from the profile alone.

    Among them are the titles of lists, for repos that have list items.
    """
    keys = F.col("key_project_files")
    components = F.concat(F.lit("## Key Components\n"), ft.bullet_lines(keys, ""))

    def title(step: int, slot: str, text: str, count: str) -> Column:
        return F.when(F.col(count) > 0, _item(step, slot, F.lit(text)))

    return _slots(
        profile,
        [
            *[item for step in fv.STEP_NAMES for item in _shared_items(step)],
            F.when(F.size(keys) > 0, _item(1, "key_components", components)),
            title(1, "entry_points", "## Entry Points", "n_entry_points"),
            _item(2, "run_commands", F.lit("### Build Commands\n")),
            title(2, "shell_scripts", "## Shell Scripts", "n_shell_scripts"),
            title(2, "root_shell_scripts", "## Root Shell Scripts", "n_root_shell_scripts"),
        ],
    )


def list_slots(corpus: Corpus) -> DataFrame:
    """Slot items of the path lists of steps 1 and 2: one line per file, from one pass."""
    entry = F.col("is_entry_point")
    shell = F.col("is_gathered") & F.col("is_shell")
    line, order = F.concat(F.lit("\n- "), "path"), F.concat(F.lit("1"), "ord")
    return _slots(
        corpus.chosen(corpus.survey.filter(entry | shell)),
        [
            F.when(entry, _item(1, "entry_points", line, order)),
            F.when(shell, _item(2, "shell_scripts", line, order)),
            F.when(
                shell & F.col("is_root_shell"), _item(2, "root_shell_scripts", line, order)
            ),
        ],
    )


def piece_slots(report_pieces: DataFrame) -> DataFrame:
    """The report as slot items of step 1."""
    return _slots(
        report_pieces, [_item(1, "formatted_analysis", F.col("text"), F.col("ord"))]
    )


def command_slots(commands: DataFrame) -> DataFrame:
    """Slot items of the commands of step 2."""
    line = F.concat(F.lit("- "), "kind", F.lit(": `"), "command", F.lit("`\n"))
    return _slots(commands, [_item(2, "run_commands", line, F.concat(F.lit("1"), "ord"))])


def content_slots(contents: DataFrame) -> DataFrame:
    """File contents as slot items: key files of step 1, configuration of step 2."""
    key = (F.col("step") == 1) & (F.col("field") == "key_files_content")
    config = (F.col("step") == 2) & (F.col("field") == "config_files")
    block = ft.fenced_block(F.col("path"), F.col("content"))
    return contents.filter(key | config).select(
        "repo", "step", F.col("field").alias("slot"), "ord", block.alias("text")
    )


def draft_slots(profile: DataFrame, earlier: DataFrame) -> DataFrame:
    """Outputs of steps 1 and 2 as slot items of step 3, or a default text."""
    defaults = {"project_purpose": fv.NO_PURPOSE, "usage_instructions": fv.NO_USAGE}
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(slot).alias("field"), F.lit(text).alias("default"))
                for slot, text in defaults.items()
            ]
        )
    )
    return (
        profile.select("repo", wanted.alias("w"))
        .select("repo", "w.*")
        .join(earlier.select("repo", "field", "content"), ["repo", "field"], "left")
        .select(
            "repo", F.lit(3).alias("step"), F.col("field").alias("slot"), F.lit("").alias("ord"),
            F.coalesce("content", "default").alias("text"),
        )
    )


def optimize_slots(context: DataFrame) -> DataFrame:
    """Slot items of step 4 that do not come from the profile."""
    evaluation = fc.truncate(
        F.col("readme_evaluation"), fv.EVALUATION_CHARS, fv.EVALUATION_KEPT, "..."
    )
    return _slots(
        context,
        [
            _item(4, "readme_recommendation", F.col("readme_recommendation")),
            _item(4, "readme_evaluation", evaluation),
            _item(4, "original_readme", F.col("original_readme")),
            _item(4, "generated_readme", F.col("generated_readme")),
        ],
    )


#: Slots with a text of their own where a step has none; step 4 has no such slot.
_DEFAULTS = {"project_purpose": fv.NO_PURPOSE, "usage_instructions": fv.NO_USAGE}


def slot_order(step: int) -> list[str]:
    """The slots of a step in the order in which they are filled."""
    if step == 4:
        return list(fv.STEP_SLOTS[4])
    shared = ["name", "language", "is_spring_boot", "build_system"]
    return shared + [s for early in (1, 2, 3) for s in fv.STEP_SLOTS[early] if s not in shared]


def _fill(template: Column, value: Callable[[str], Column]) -> Column:
    """The template of a step with its placeholders filled, in the fixed order."""
    values = {s: value(s) for s in slot_order(1)}
    for slot, default in _DEFAULTS.items():
        values[slot] = F.when(values[slot] == "", F.lit(default)).otherwise(values[slot])
    last = {s: value(s) for s in slot_order(4)}
    return F.when(F.col("step") == 4, ft.render_template(template, last)).otherwise(
        ft.render_template(template, values)
    )


def build_prompts(slots: DataFrame, steps: DataFrame) -> DataFrame:
    """``repo, step, prompt`` from slot items ``repo, step, slot, ord, text`` and the step
    templates.

    The items of a prompt are put together once, whatever their size, and the template of its
    step is filled. `prompt_pieces` is the form for prompts beyond what one value should hold.
    """
    keys = ["repo", "step"]
    templates = F.broadcast(steps.select("step", "template"))  # one row per step
    grouped = (
        slots.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("slot", "ord", "text"))).alias("items"))
        .join(templates, "step")
    )

    def value(slot: str) -> Column:
        of_slot = F.filter("items", lambda x: x.slot == slot)
        return F.array_join(F.transform(of_slot, lambda x: x.text), "")

    text = _fill(F.col("template"), value)
    return grouped.select(*keys, fc.fold_newlines(text).alias("prompt"))


def prompt_pieces(slots: DataFrame, steps: DataFrame) -> DataFrame:
    """``repo, step, part, text``: the items of every prompt, ordered by `part`, any task's rows.

    Joined, and with runs of blank lines folded, they are the prompt of `build_prompts`, but
    for placeholders inside an inserted text, which stay. A placeholder that stands twice in a
    template gets its items twice. No prompt is held as one value, and the items of one prompt
    may lie in many tasks. `streamed_prompts` gives the exact text.
    """
    holder = r"\$\{(\w+)\}"
    templates = steps.select(
        "step", F.posexplode(F.split("template", holder)).alias("i", "literal"),
        F.regexp_extract_all("template", F.lit(holder), F.lit(1)).alias("slots"),
    )
    place = F.lpad(F.col("i").cast("string"), 9, "0")
    fixed = templates.select(
        "step", F.concat(place, F.lit("1")).alias("part"), F.col("literal").alias("text")
    )
    holes = templates.select("step", F.get("slots", F.col("i")).alias("slot"), place.alias("at"))
    shown = slots.join(F.broadcast(holes), ["step", "slot"]).select(  # a few rows per step
        "repo", "step", F.concat("at", F.lit("2"), "ord").alias("part"), "text"
    )
    whole = slots.select("repo", "step").distinct().join(F.broadcast(fixed), "step")
    return shown.unionByName(whole.select("repo", "step", "part", "text"))


_KEYS = [("repo", pa.string()), ("step", pa.int32())]
_PIECES = pa.schema([*_KEYS, ("part", pa.int32()), ("text", pa.string())])
_OUTPUTS = pa.schema([*_KEYS, ("output", pa.string())])


def _filled(template: str, step: int, values: SlotValues) -> Iterator[str]:
    """A template with its slots filled one after the other, as `text.render_template` does."""
    out: Iterable[str] = iter([template])
    for slot in slot_order(step):
        def value(slot: str = slot) -> Iterable[str]:
            if step != 4 and slot in _DEFAULTS and values.is_empty(slot):
                return [_DEFAULTS[slot]]
            return values.pieces(slot)

        out = replaced(out, "${" + slot + "}", value)
    return folded(out)


def streamed_prompts(slots: DataFrame, steps: DataFrame, size: int = PIECE) -> DataFrame:
    """``repo, step, part, text``: the prompts of `build_prompts` in pieces of ``size`` characters.

    Joined in the order of `part` they are that prompt, character by character: placeholders
    inside inserted texts are filled in their turn, and blank lines are folded across pieces.
    The items of a prompt are sorted by Spark and streamed; what one prompt needs beyond a few
    megabytes lies in a file of its task, so a prompt of any size takes little memory. The step
    templates, one row per step, are taken to the driver.
    """
    templates = {r.step: r.template for r in steps.select("step", "template").collect()}
    keys = ["repo", "step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(pieces(rows_of(batches, *keys, "slot", "text")), _PIECES, 3)
        give_back()

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (repo, step), items in groupby(rows, key=lambda r: r[:2]):
            values = SlotValues()
            for _, _, slot, text in items:
                if slot is not None and text:
                    values.add(slot, text)
            for part, text in enumerate(evenly(_filled(templates[step], step, values), size)):
                yield repo, step, part, text
            values.close()

    known = slots.filter(F.col("step").isin([*templates]))
    dealt = known.select(*keys, "slot", "ord", "text").repartition(*keys)
    ordered = dealt.sortWithinPartitions(*keys, "slot", "ord", "text")
    return ordered.select(*keys, "slot", "text").mapInArrow(
        run, "repo string, step int, part int, text string"
    )


# -- U4 ---------------------------------------------------------------------

def run_completions(prompts: DataFrame, fn: Callable) -> DataFrame:
    """``repo, step, output``: the caller's function applied to every prompt.

    Whole prompts (``repo, step, prompt``) go to ``fn`` batch by batch: it gets an iterator of
    pandas frames ``repo, step, prompt`` and yields frames ``repo, step, output``.

    Prompts in pieces (``repo, step, part, text``, of `streamed_prompts` or `prompt_pieces`) are
    sorted, and ``fn(repo, step, pieces)`` is called once for each ``(repo, step)``; ``pieces``
    is an iterator over its texts in order, which come one by one, and ``fn`` returns the
    output or None. It need not take all pieces. No prompt is held as one value.
    """
    if "part" not in prompts.columns:
        return prompts.select("repo", "step", "prompt").mapInPandas(
            fn, "repo string, step int, output string"
        )
    keys = ["repo", "step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(outputs(rows_of(batches, *keys, "text")), _OUTPUTS, 2)
        give_back()

    def outputs(every: Iterator[tuple]) -> Iterator[tuple]:
        for (repo, step), rows in groupby(every, key=lambda r: r[:2]):
            output = fn(repo, step, (text for _, _, text in rows if text is not None))
            for _ in rows:  # what the function left
                pass
            yield repo, step, output

    dealt = prompts.select(*keys, "part", "text").repartition(*keys)
    ordered = dealt.sortWithinPartitions(*keys, "part").select(*keys, "text")
    return ordered.mapInArrow(run, "repo string, step int, output string")


# -- C12 --------------------------------------------------------------------

def plan_steps(
    repos: DataFrame, step_outputs: DataFrame, start: int | None = None, only: bool = False
) -> DataFrame:
    """``repo, step`` to run: one step, all from a step, or those after the last finished."""
    last = max(fv.STEP_NAMES)
    if only and start is None:
        raise ValueError("only=True needs a start step")
    if start is not None:
        if start not in fv.STEP_NAMES:
            raise ValueError(f"start must be one of {sorted(fv.STEP_NAMES)}, not {start}")
        steps = [start] if only else list(range(start, last + 1))
        return repos.select("repo", F.explode(F.array(*map(F.lit, steps))).alias("step"))
    done = F.coalesce("step", F.lit(0))
    # a finished step that is not one of the known ones starts the run anew
    first = F.when(done.between(1, last), done + 1).otherwise(F.lit(1))
    return (
        repos.select("repo")
        .join(last_completed_step(step_outputs), "repo", "left")
        .select("repo", first.cast("int").alias("first"))
        .filter(F.col("first") <= last)
        .select("repo", F.explode(F.sequence("first", F.lit(last))).alias("step"))
    )


# -- C13 --------------------------------------------------------------------

def finalize(
    step_outputs: DataFrame, date: str, model: str, final_step: int = max(fv.STEP_NAMES)
) -> DataFrame:
    """``repo, readme, reasoning``: the cleaned final output with its watermark."""
    parts = fc.extract_reasoning(F.col("output"))
    return (
        step_outputs.filter(F.col("step") == final_step)
        .select("repo", parts.alias("parts"))
        .select(
            "repo",
            ft.watermark(F.col("parts.text"), date, model).alias("readme"),
            F.col("parts.reasoning").alias("reasoning"),
        )
    )
