import random

import pytest

from repoatlas.operators import aggregate as agg
from repoatlas.operators.gather import gather_array, gather_text


def pieces(spark):
    rng = random.Random(3)
    rows = []
    for repo, n in {"small": 3, "hot": 400, "one": 1}.items():
        rows += [(repo, f"{i:04d}", f"<{repo}{i}>" + "\n" * rng.randint(0, 2)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "repo string, ord string, text string").repartition(5)


@pytest.mark.parametrize("in_pieces", [False, True])
def test_parts_make_up_the_whole_text(spark, in_pieces):
    rows, df = pieces(spark)
    made = gather_text(df, ["repo"], pieces=in_pieces).collect()
    for repo in ("small", "hot", "one"):
        expected = "".join(text for r, _, text in sorted(rows) if r == repo)
        parts = sorted((m.part, m.text) for m in made if m.repo == repo)
        assert "".join(text for _, text in parts) == expected
    hot = [m for m in made if m.repo == "hot"]
    assert len(hot) == (400 if in_pieces else 1)
    assert all(m.part == "" for m in made) == (not in_pieces)


def test_arrays(spark):
    rows, df = pieces(spark)
    made = {m.repo: m.text for m in gather_array(df, ["repo"], "text").collect()}
    assert made["small"] == [t for r, _, t in sorted(rows) if r == "small"]


def test_content_maps_of_a_large_repo(spark):
    rows = [("r", "java", f"{i}/readme.md", f"text {i}", f"1{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "repo string, analyzer string, path string, content string, ord string")
    for in_pieces, n in ((False, 1), (True, 30)):
        made = agg.content_maps(df, in_pieces).collect()
        assert len(made) == n
        merged = {k: v for m in made for k, v in m.contents.items()}
        assert merged == {row[2]: row[3] for row in rows}


def test_group_api(spark):
    schema = "repo string, type string, method string, endpoint string, name string, repository string, ord string"
    rows = [
        ("r", "Controller", "GET", "/a", None, None, "1"),
        ("r", "Controller", None, "/b", "B", None, "2"),
        ("r", None, None, None, None, "Repo", "3"),
        ("r", "Empty", None, None, None, None, "4"),
    ]
    made = agg.group_api(spark.createDataFrame(rows, schema))
    assert {(m.type, m.lines) for m in made.collect()} == {
        ("Controller", "- GET /a\n- B"), ("Other", "- Repository: Repo"),
    }


def test_steps(spark):
    outputs = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "z"), ("b", 1, ""), ("c", 5, "v"), ("d", 4, "w")],
        "repo string, step int, output string",
    )
    last = {m.repo: m.step for m in agg.last_completed_step(outputs).collect()}
    assert last == {"a": 3, "b": 0, "c": 5, "d": 4}
    assert [(m.repo, m.text) for m in agg.combine_outputs(outputs, 4).collect()] == [("a", "x\n\nz")]
