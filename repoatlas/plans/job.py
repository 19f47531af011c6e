"""The whole run for a corpus: survey, profile, contexts and prompts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.functions.languages import BUILT_IN, LanguageRules
from repoatlas.operators import extract
from repoatlas.operators.aggregate import command_groups
from repoatlas.operators.joins import readme_pair
from repoatlas.plans import contexts, prompts
from repoatlas.plans.profile import Corpus, profile_repos, report_pieces, survey_corpus
from repoatlas.sources.scratch import drop_folder, save_table, scratch_folder


@dataclass(frozen=True)
class Run:
    """Tables of a run, all but the file contents written once.

    The contents of the corpus are read for three of them: the survey, the dependencies
    and the contents of the picked files.
    """

    corpus: Corpus
    profile: DataFrame
    dependencies: DataFrame
    folder: str

    def report_pieces(self, api_patterns: DataFrame | None = None) -> DataFrame:
        return report_pieces(self.corpus, self.profile, self.dependencies, api_patterns)

    def close(self) -> None:
        """Delete the tables of the run; DataFrames that read them can no longer be used."""
        drop_folder(self.profile.sparkSession, self.folder)


def start_run(
    files: DataFrame, language: str = "auto", max_size: int | None = fv.MAX_FILE_BYTES,
    languages: Sequence[LanguageRules] = BUILT_IN,
) -> Run:
    """Survey the corpus, extract the dependencies and write the profile.

    The tables lie in one new folder until `Run.close`.
    """
    folder = scratch_folder(files.sparkSession)
    corpus = survey_corpus(
        files, language, max_size=max_size, languages=languages, folder=folder
    )
    dependencies = extract.find_dependencies(extract.readable_files(files, corpus.max_size))
    profile = save_table(profile_repos(corpus), f"{folder}/profile")
    return Run(corpus, profile, save_table(dependencies, f"{folder}/dependencies"), folder)


def picked_contents(run: Run) -> DataFrame:
    """Contents all steps need, from one look-up."""
    picks = (
        contexts.purpose_picks(run.corpus)
        .unionByName(contexts.usage_picks(run.corpus))
        .unionByName(contexts.original_picks(run.corpus))
    )
    return save_table(contexts.look_up(run.corpus, picks), scratch_folder(run.profile.sparkSession, run.folder))


def first_slots(run: Run, contents: DataFrame) -> DataFrame:
    """Slot items of the steps that need nothing but the repo: 1 and 2.

    The items of the profile are those of all steps.
    """
    commands = command_groups(run.profile, extract.find_commands(run.corpus.survey))
    return (
        prompts.profile_slots(run.profile)
        .unionByName(prompts.list_slots(run.corpus))
        .unionByName(prompts.piece_slots(run.report_pieces()))
        .unionByName(prompts.command_slots(run.corpus.chosen(commands)))
        .unionByName(prompts.content_slots(contents))
    )


def draft_slots(run: Run, step_outputs: DataFrame) -> DataFrame:
    """Slot items of step 3, from the outputs of steps 1 and 2."""
    return prompts.draft_slots(run.profile, contexts.earlier_outputs(step_outputs))


def final_slots(
    run: Run, contents: DataFrame, step_outputs: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """Slot items of step 4, from the output of step 3 and the verdict on the old README."""
    originals = contents.filter(F.col("field") == "original_readme")
    pair = readme_pair(run.corpus.analyzers, originals, step_outputs)
    return prompts.optimize_slots(contexts.optimize_context(pair, verdicts))


def prompt_batch(slots: DataFrame, steps: DataFrame) -> DataFrame:
    """Prompts of a batch of slot items, which are read once."""
    return prompts.build_prompts(slots, steps)
