"""What the physical plans must and must not do."""

import re

import pytest

from repoatlas.catalog import views
from repoatlas.functions import paths as fp
from repoatlas.operators import aggregate as agg
from repoatlas.operators import rank
from repoatlas.operators.classify import gathered, select_analyzer, survey_files
from repoatlas.operators.gather import gather_text


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus") / "files")
    views.files(spark, "/root/testdata/sf0.001").write.parquet(folder)
    return spark.read.parquet(folder)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged_columns(df) -> list[str]:
    """Outputs of the operators right below each shuffle, from the formatted plan."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)


def test_content_is_never_shuffled_for_ranking(files):
    inputs = exchanged_columns(rank.top_n(gathered(survey_files(files)), 10))
    assert inputs and not [i for i in inputs if "content" in i]


def test_content_is_never_shuffled_for_aggregates(files):
    survey = survey_files(files)
    for df in (agg.repo_counts(survey), agg.language_stats(survey), agg.build_system(survey)):
        inputs = exchanged_columns(df)
        assert inputs and not [i for i in inputs if "content" in i]


def test_top_n_cuts_before_the_shuffle(files):
    text = plan(rank.top_n(gathered(survey_files(files)), 10))
    below = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in below


def test_classification_has_no_join_before_aggregates(files):
    assert "Join" not in plan(agg.repo_counts(survey_files(files)))


def test_analyzers_read_paths_only(files):
    text = plan(select_analyzer(files))
    assert "ReadSchema: struct<repo:string,path:string>" in text


def test_path_filters_reach_the_scan(files):
    text = plan(files.filter(fp.is_shell()).select("repo", "path"))
    assert "StringEndsWith(path,.sh)" in text


def test_no_python_workers(files):
    survey = survey_files(files)
    text = plan(rank.top_by_category(gathered(survey), {"a": fp.is_config("path")}))
    assert not re.search("PythonUDF|EvalPython|MapInPandas|MapInArrow", text)


def test_gathering_broadcasts_nothing(files):
    text = plan(gather_text(files.selectExpr("repo", "path ord", "content text"), ["repo"]))
    assert "Broadcast" not in text and "NestedLoop" not in text


def test_results_do_not_depend_on_partitions(spark, files):
    def result(partitions: str, split: int):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        survey = survey_files(files.repartition(split))
        ranked = rank.top_n(gathered(survey), 3)
        return sorted(map(tuple, ranked.select("repo", "analyzer", "path", "rank").collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert result("1", 1) == result("8", 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_generated_methods_stay_compilable(spark, files):
    """The JVM never compiles methods over 8000 bytes of code."""
    debug = getattr(
        getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$"
    )
    for df in (survey_files(files), survey_files(files, "java")):
        text = debug.codegenString(df._jdf.queryExecution().executedPlan())
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
        assert sizes and max(sizes) < 8000
