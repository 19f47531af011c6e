"""Quality of existing READMEs, and the prompt that asks for a verdict."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.functions import content as fc


# -- C8 ---------------------------------------------------------------------

def readme_quality(
    pair: DataFrame, verdicts: DataFrame, keep_texts: bool = False
) -> DataFrame:
    """``repo, is_low_quality, recommendation, reason``; both texts too with ``keep_texts``.

    A missing or tiny README is low quality without asking; otherwise the verdict text
    (``verdicts(repo, output)``) decides, and a missing verdict keeps the original.
    """
    body = fc.strip(F.coalesce("original_readme", F.lit("")))
    minimal = (body == fv.NO_ORIGINAL_README) | (F.length(body) < fv.MIN_README_CHARS)
    output = F.col("output")
    low = F.when(minimal, F.lit(True)).otherwise(
        F.coalesce(fc.parse_verdict(output), F.lit(False))
    )
    reason = F.when(minimal, F.lit(fv.MINIMAL_README_REASON)).otherwise(
        F.coalesce(output, F.lit(fv.EVALUATION_ERROR))
    )
    return pair.join(verdicts.select("repo", "output"), "repo", "left").select(
        "repo",
        low.alias("is_low_quality"),
        F.when(low, F.lit(fv.OVERWRITE)).otherwise(F.lit(fv.RESPECT_ORIGINAL)).alias(
            "recommendation"
        ),
        reason.alias("reason"),
        *(["original_readme", "generated_readme"] if keep_texts else []),
    )


# -- C9 ---------------------------------------------------------------------

def readme_quality_rules(readmes: DataFrame, text: str = "content") -> DataFrame:
    """Signs of low quality as boolean columns, and how many there are."""
    signs = fc.quality_signs(F.col(text))
    flags = [column.alias(name) for name, column in signs.items()]
    n = reduce(add, [column.cast("int") for column in signs.values()])
    return readmes.select(
        *[c for c in readmes.columns if c != text], *flags, n.alias("n_signs")
    )


# -- C11 --------------------------------------------------------------------

def evaluation_template(samples: list[str]) -> str:
    """The verdict prompt with the given low-quality samples in it."""
    blocks = []
    for number, sample in enumerate(samples, 1):
        body = "\n".join("    " + line if line else line for line in sample.split("\n"))
        blocks.append(f"    EXAMPLE {number}:\n    ```\n{body}\n    ```\n")
    return fv.EVALUATION_TEMPLATE.replace("{samples}", "\n".join(blocks))


def evaluation_prompts(
    pair: DataFrame, samples: list[str] = fv.LOW_QUALITY_SAMPLES
) -> DataFrame:
    """``repo, prompt`` for every README that has to be judged."""
    before, rest = evaluation_template(samples).split("{readme_content}")
    between, after = rest.split("{generated_readme}")
    body = fc.strip(F.coalesce("original_readme", F.lit("")))
    judged = (body != fv.NO_ORIGINAL_README) & (F.length(body) >= fv.MIN_README_CHARS)
    return pair.filter(judged).select(
        "repo",
        F.concat(
            F.lit(before), "original_readme", F.lit(between), "generated_readme", F.lit(after)
        ).alias("prompt"),
    )
