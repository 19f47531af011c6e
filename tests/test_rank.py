import random

import pytest
from pyspark.sql import functions as F

from repoatlas.functions import score as fs
from repoatlas.operators import rank
from tests.helpers import evaluate, make_files, matches

SCHEMA = "repo string, analyzer string, path string, ord string, importance_score int, tags array<string>"


def random_files(seed: int, repos: int = 12):
    rng = random.Random(seed)
    rows = []
    for r in range(repos):
        for i in range(rng.randint(1, 25)):
            tags = [t for t in "abc" if rng.random() < 0.45]
            path = f"p{i:02d}"
            rows.append((f"r{r}", "java", path, "1" + path, rng.randint(0, 4), tags))
    return rows


def greedy(rows, names, k, total):
    """Take the best k of each category that are new, then the best of the rest."""
    best = sorted(rows, key=lambda row: (-row[4], row[3]))
    picked = []
    for name in names:
        new = [row[2] for row in best if name in row[5] and row[2] not in picked]
        picked += new[:k]
    rest = [row[2] for row in best if row[2] not in picked[:total]]
    return (picked[:total] + rest)[:total]


@pytest.mark.parametrize("k, total, partitions", [(1, 5, "1"), (2, 4, "8"), (3, 25, "8"), (2, 1, "3")])
def test_top_by_category_equals_greedy(spark, k, total, partitions):
    rows = random_files(k * 100 + total)
    files = spark.createDataFrame(rows, SCHEMA)
    categories = {t: F.array_contains("tags", t) for t in "abc"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        made = rank.top_by_category(files, categories, k, total).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for repo in {row[0] for row in rows}:
        got = [m.path for m in sorted(made, key=lambda m: m.position) if m.repo == repo]
        assert got == greedy([r for r in rows if r[0] == repo], "abc", k, total)


def test_top_by_category_limits(spark):
    files = spark.createDataFrame(random_files(1), SCHEMA)
    with pytest.raises(ValueError):
        rank.top_by_category(files, {}, 3, 0)
    assert rank.top_by_category(files, {}, 3, 2).groupBy("repo").count().agg(F.max("count")).first()[0] <= 2


def test_top_n_and_sort(spark):
    rows = random_files(7)
    files = spark.createDataFrame(rows, SCHEMA)
    expected = {
        (repo, row[2], i)
        for repo in {r[0] for r in rows}
        for i, row in enumerate(
            sorted((r for r in rows if r[0] == repo), key=lambda r: (-r[4], r[3]))[:4], 1
        )
    }
    assert matches(rank.top_n(files, 4), "repo", "path", "rank") == expected
    ordered = [(r.repo, r.path) for r in rank.sort_by_importance(files).collect()]
    assert ordered == [(r[0], r[2]) for r in sorted(rows, key=lambda r: (r[0], -r[4], r[3]))]


def test_cap_rows(spark):
    rows = [("a", f"l{i}", f"{i}") for i in range(5)] + [("b", "only", "0")]
    made = rank.cap_rows(spark.createDataFrame(rows, "repo string, line string, ord string"), 2, "... and %d more", ["repo"])
    assert matches(made, "repo", "position", "line") == {
        ("a", 1, "l0"), ("a", 2, "l1"), ("a", 3, "... and 3 more"), ("b", 1, "only"),
    }


def test_priority_order(spark):
    rows = [("r", "java", p, "1" + p, e) for p, e in [("a", False), ("build.gradle", False), ("z", True)]]
    df = spark.createDataFrame(rows, "repo string, analyzer string, path string, ord string, is_entry_point boolean")
    assert [r.path for r in rank.priority_order(df).collect()] == ["build.gradle", "z", "a"]


# path, content, key file, entry point -> scores written out by hand
SCORED = [
    ("src/Application.java", "@SpringBootApplication\npublic static void main(", False, True, 100 + 110 + 70 + 10 + 30),
    ("build.gradle", "id 'org.springframework.boot'\ntask a\ntask b", True, False, 80 + 75 + 25 + 10),
    ("build.gradle", "java", True, False, 80 + 75 + 20),
    ("application-local.yml", "", True, False, 80 + 70 + 70 + 10),
    ("application-env-local.yml.example", "", True, False, 80 + 70 + 100),
    ("web/OrderController.java", "@RestController @GetMapping @PostMapping", False, False, 60 + 10 + 16),
    ("start.sh", "", False, False, 65),
    ("Dockerfile", "", True, False, 80 + 70),
    ("docker-compose.yml", "", True, False, 80 + 75),
    ("src/dao/X.java", None, False, False, 50),
    ("notes.txt", "@SpringBootApplication", False, False, 110),
]


def test_score_java(spark):
    df = spark.createDataFrame(
        [(i, *row[:4]) for i, row in enumerate(SCORED)],
        "i int, path string, content string, is_key_file boolean, is_entry_point boolean",
    )
    rows = df.select("i", fs.score_java(True).alias("s"), fs.score_understanding(True).alias("u")).collect()
    made = {row.i: (row.s, row.u) for row in rows}
    without = {6: 0, 7: 80, 8: 80}
    for i, row in enumerate(SCORED):
        assert made[i] == (row[4], without.get(i, row[4])), row[0]


def test_generic_scores(spark):
    paths = ["src/main/Order.java", "x.yml.example", "y", None]
    assert evaluate(spark, paths[:3], lambda p: fs.score_by_criteria({"main": 2, "order": 3, "y": 5}, p)) == [5, 5, 5]
    assert evaluate(spark, paths[:3], lambda p: fs.score_by_type({".example": 4, ".yml.example": 9, ".java": 1}, p)) == [1, 4, 0]
    files = make_files(spark, {"r": {"a.java": "class A class B", "b.md": "class", "c.java": None, "d.java": ""}})
    rules = {".java": {r"class \w": 2, "zzz": 100}, "a": {"class": 50}}
    made = files.select("path", fs.score_by_content(rules).alias("s"))
    assert matches(made, "path", "s") == {("a.java", 4), ("b.md", 0), ("c.java", 0), ("d.java", 0)}
    both = fs.score_combined([lambda: fs.score_by_type({".java": 1}), F.length("path")])
    assert matches(files.select("path", both.alias("s")), "path", "s") >= {("a.java", 7), ("b.md", 4)}
