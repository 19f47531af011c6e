from pathlib import PurePosixPath

import pytest

from repoatlas import fixed_values as fv
from repoatlas.functions import paths as fp
from tests.helpers import evaluate

SUFFIXES = {
    "a/b.C": ".c", ".gitignore": "", "x/.env": "", "a.b.c": ".c", "foo.": "",
    "application.yml.example": ".example", "dir.d/name": "", "..a": ".a", "a b/c d.Java": ".java",
}


def test_suffix(spark):
    assert evaluate(spark, list(SUFFIXES), fp.suffix) == list(SUFFIXES.values())


def test_suffix_equals_pathlib(spark):
    paths = [p for p in SUFFIXES if p not in ("..a", "foo.")]
    assert evaluate(spark, paths, fp.suffix) == [PurePosixPath(p).suffix.lower() for p in paths]


def test_parts(spark):
    paths = ["a/b/c.txt", "c.txt", "a b/c"]
    assert evaluate(spark, paths, fp.file_name) == ["c.txt", "c.txt", "c"]
    assert evaluate(spark, paths, fp.directory) == ["a/b", "", "a b"]


@pytest.mark.parametrize(
    "match, expected", [("segment", [True, False, False, True, False, True]),
                        ("substring", [True, True, False, True, False, True])],
)
def test_excluded_dirs(spark, match, expected):
    paths = ["src/target/x.java", "src/targets/x.java", "target", "build/x", "x/build", "a/.git/b/c"]
    assert evaluate(spark, paths, lambda p: fp.in_excluded_dir(p, match=match)) == expected


def test_excluded_dirs_argument(spark):
    assert evaluate(spark, ["out/x", "build/x"], lambda p: fp.in_excluded_dir(p, ["out"])) == [
        True, False,
    ]
    with pytest.raises(ValueError):
        fp.in_excluded_dir(match="other")


@pytest.mark.parametrize("analyzer", fv.ANALYZERS)
def test_key_files(spark, analyzer):
    names = fv.COMMON_KEY_FILES + fv.KEY_FILES[analyzer]
    assert all(evaluate(spark, names, lambda p: fp.is_key_file(analyzer, p)))
    nested = ["sub/" + n for n in names]
    assert not any(evaluate(spark, nested, lambda p: fp.is_key_file(analyzer, p)))


def test_analyzable(spark):
    paths = ["A.java", "A.JAVA", "x.sh", "my-config.json.template", "docs/readme.md", "a.py", "a.md"]
    java = evaluate(spark, paths, lambda p: fp.is_analyzable("java", p))
    assert java == [True, False, True, True, True, False, False]
    strict = evaluate(spark, paths, lambda p: fp.is_analyzable("java", p, readme_md=False))
    assert strict == [True, False, True, True, False, False, False]
    assert evaluate(spark, ["a.py"], lambda p: fp.is_analyzable("python", p)) == [True]


def test_flags(spark):
    cases = {
        fp.is_sonar: {"Sonar-Project.properties": True, "a/.sonar/x": True, "a/son.ar": False},
        fp.is_ci_file: {".gitlab-ci.yml": True, "a/.gitlab-ci.yml": False},
        fp.is_config: {
            "a.yml": True, "A.INI": True, "x.sample": True, "src/env.txt": True, "run.sh": True,
            "Main.java": False, "docs/readme.md": False, "src/settings/x": True,
        },
        fp.is_config_lite: {"a.yaml": True, "a.ini": False, "src/Application.java": True, "x": False},
        fp.is_shell: {"a.sh": True, "a.SH": False},
        fp.is_root_shell: {"a.sh": True, "b/a.sh": False, "b\\a.sh": False, "a": False},
        fp.is_example_config: {
            "application.yml.example": True, "x.example": False, "config/x.template": True,
        },
        fp.is_special_config: {"a/application.yml.example": True, "application.yml": False},
        fp.is_readme: {"README.md": True, "my-readme.md": True, "readme": False},
        fp.is_original_readme: {
            "README.md": True, "my-readme.md": False, "a/ReadMe.md": True, "Readme": True, "read.me": True,
        },
    }
    for make, table in cases.items():
        assert evaluate(spark, list(table), make) == list(table.values()), make.__name__
    by_name = evaluate(
        spark, ["config/x.template", "x-config.template"], lambda p: fp.is_example_config(p, on="name")
    )
    assert by_name == [False, True]


def test_language(spark):
    paths = ["A.java", "b.GRADLE", "c.yml", "d.py", "e", "f.tsx"]
    expected = {
        "java": ["Java", "Gradle", "YAML", "Unknown", "Unknown", "Unknown"],
        "python": ["Unknown", "Unknown", "YAML", "Python", "Unknown", "Unknown"],
        "javascript": ["Unknown", "Unknown", "Unknown", "Unknown", "Unknown", "React TypeScript"],
    }
    for analyzer, languages in expected.items():
        assert evaluate(spark, paths, lambda p: fp.detect_language(analyzer, p)) == languages


def test_script_command(spark):
    paths = ["start.sh", "stop-it.sh", "Run.sh", "a/start.sh", "other.sh", "restart-and-stop.sh"]
    made = evaluate(spark, paths, fp.script_command)
    assert [tuple(m) if m else None for m in made] == [
        ("run", "./start.sh"), ("stop", "./stop-it.sh"), ("run", "./Run.sh"), None, None,
        ("run", "./restart-and-stop.sh"),
    ]


def test_key_file_category(spark):
    paths = ["application.yml", "application.yml.example", "build.gradle"]
    assert evaluate(spark, paths, fp.key_file_category) == ["config", "example", "other"]


def test_candidate_covers_every_gathered_path(spark):
    paths = ["A.java", "x.sh", "a.vue", "config/a.example", "docs/readme.md", ".eslintrc", "poetry.lock"]
    assert all(evaluate(spark, paths, fp.is_candidate))
    assert not any(evaluate(spark, ["a.png", "build/A.java", "x/y.lock"], fp.is_candidate))
