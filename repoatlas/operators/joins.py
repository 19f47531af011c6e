"""Key lookups and membership tests between the tables of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.functions import content as fc
from repoatlas.functions import paths as fp
from repoatlas.operators.classify import REPO
from repoatlas.operators.rank import top_n


# -- J1 ---------------------------------------------------------------------

def merge_passes(keys: DataFrame, walked: DataFrame) -> DataFrame:
    """Key files, and the walked files that are not among them."""
    return keys.unionByName(walked.join(keys, ["repo", "path"], "left_anti"))


# -- J2 ---------------------------------------------------------------------

def content_lookup(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Paths with their content; missing and blank files drop out.

    The join key is the single file, so no repo makes a hot partition; few paths are
    broadcast by AQE, and the contents then stay where they are.
    """
    texts = files.select("repo", "path", "content").filter(fc.non_blank())
    return paths.join(texts, ["repo", "path"])


# -- J3 ---------------------------------------------------------------------

def key_paths(gathered: DataFrame, n: int | None) -> DataFrame:
    """Entry points, key files and the best ``n`` (None: all) files of each repo, each once."""
    if n is None:
        return gathered.select(*REPO, "path", "ord")
    flagged = F.col("is_entry_point") | F.col("is_key_file")
    columns = [*REPO, "path", "ord"]
    best = top_n(gathered, n).filter(~flagged)
    return gathered.filter(flagged).select(*columns).unionByName(best.select(*columns))


# -- J6 ---------------------------------------------------------------------

def original_readme(gathered: DataFrame) -> DataFrame:
    """``repo, analyzer, path, ord``: the best scored README in the strict sense."""
    return top_n(gathered.filter(fp.is_original_readme()), 1).select(*REPO, "path", "ord")


def readme_pair(repos: DataFrame, originals: DataFrame, step_outputs: DataFrame) -> DataFrame:
    """``repo, original_readme, generated_readme``, with a default text for no original.

    ``originals`` has the content of the original README of a repo; the generated one is
    the output of step 3, without a fence around it.
    """
    generated = step_outputs.filter(F.col("step") == 3).select(
        "repo", fc.strip_fence(F.col("output")).alias("generated_readme")
    )
    found = originals.filter(fc.non_blank()).select(
        "repo", F.col("content").alias("original_readme")
    )
    return (
        repos.select("repo")
        .join(found, "repo", "left")
        .join(generated, "repo", "left")
        .select(
            "repo",
            F.coalesce("original_readme", F.lit(fv.NO_ORIGINAL_README)).alias("original_readme"),
            F.coalesce("generated_readme", F.lit("")).alias("generated_readme"),
        )
    )


# -- J7, J8 -----------------------------------------------------------------

def attach_completions(prompts: DataFrame, completions: DataFrame) -> DataFrame:
    """Prompts with their model output; null where there is none."""
    return prompts.join(completions.select("repo", "step", "output"), ["repo", "step"], "left")


def failed_steps(prompts: DataFrame, completions: DataFrame) -> DataFrame:
    """Steps that were asked for and have no output."""
    return prompts.select("repo", "step").join(completions, ["repo", "step"], "left_anti")


def pending_steps(repos: DataFrame, step_outputs: DataFrame) -> DataFrame:
    """``repo, step``: steps of each repo without a non-empty output."""
    steps = F.explode(F.array(*[F.lit(s) for s in fv.STEP_NAMES])).alias("step")
    done = step_outputs.filter(F.length("output") > 0).select("repo", "step")
    return repos.select("repo", steps).join(done, ["repo", "step"], "left_anti")
