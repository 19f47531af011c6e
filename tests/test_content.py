import time

from repoatlas.functions import content as fc
from repoatlas.functions import text as ft
from pyspark.sql import functions as F
from tests.helpers import evaluate


def test_decode_text(spark):
    raw = [b"ok", b"a\xffb", b"one\r\ntwo\rthree", b"", "é".encode()]
    assert evaluate(spark, raw, fc.decode_text, "binary") == ["ok", "ab", "one\ntwo\nthree", "", "é"]


def test_non_blank(spark):
    assert evaluate(spark, ["a", " \t\n", "", None], fc.non_blank) == [True, False, False, False]


def test_contains_any(spark):
    texts = ["Foo bar", "", None]
    assert evaluate(spark, texts, lambda c: fc.contains_any(["bar", "foo", "Foo"], c)) == [
        ["bar", "Foo"], [], [],
    ]
    assert evaluate(
        spark, texts, lambda c: fc.contains_any(["BAR", "zzz"], c, case_sensitive=False)
    ) == [["bar"], [], []]


def test_extract_patterns(spark):
    texts = ["a=1\nb=2", "", None]
    found = evaluate(
        spark, texts, lambda c: fc.extract_patterns({"all": "a.*2", "key": r"(\w)="}, c)
    )
    assert found[0] == {"all": ["a=1\nb=2"], "key": ["a", "b"]}
    assert found[1] == found[2] == {"all": [], "key": []}
    several = evaluate(
        spark, texts, lambda c: fc.extract_patterns({"pair": r"(\w)=(\w)", "key": r"(\w)="}, c)
    )
    assert [tuple(p) for p in several[0].pair] == [("a", "1"), ("b", "2")]
    assert several[0].key == ["a", "b"] and several[1].pair == []


def test_extract_reasoning(spark):
    texts = [
        "  no comment\n\n\n\nhere ",
        "# T\n\n\n<!-- why -->\n\n\nend\n",
        "<!--a\nb--> x <!-- c -->",
        "<!-- é --> open <!-- never\n\n\n\nclosed",
        "<!-- never closed",
        "only --> closed ",
    ]
    made = evaluate(spark, texts, fc.extract_reasoning)
    assert [tuple(m) for m in made] == [
        ("  no comment\n\n\n\nhere ", ""),
        ("# T\n\nend", "why"),
        ("x", "a\nb\n\nc"),
        ("open <!-- never\n\nclosed", "é"),
        ("<!-- never closed", ""),
        ("only --> closed ", ""),
    ]


def test_many_open_comments_are_quick(spark):
    start = time.monotonic()
    made = evaluate(spark, ["<!-- x -->" + "<!-- " * 40000], fc.extract_reasoning)
    assert made[0].reasoning == "x" and time.monotonic() - start < 20


def test_fold_newlines(spark):
    assert evaluate(spark, ["a\n\n\n\nb\n\nc\nd"], fc.fold_newlines) == ["a\n\nb\n\nc\nd"]


def test_strip_fence(spark):
    cases = {
        "plain": "plain",
        "```markdown\n# T\n```": "# T",
        "```\nx\n```\ntail": "x",
        "```\na\n```b```\nc\n```": "a\n```b```\nc",
        "```\nunclosed": "```\nunclosed",
        "``````": "``````",
        "```x```": "```x```",
        "```markdown```\n": "```markdown```\n",
        "```\n\n```": "",
        "```md\né\n``` ü": "é",
        "": "",
    }
    assert evaluate(spark, list(cases), fc.strip_fence) == list(cases.values())


def test_truncate(spark):
    texts = ["x" * 1000, "x" * 1001, "é" * 1001]
    made = evaluate(spark, texts, lambda c: fc.truncate(c, 1000, 997, "..."))
    assert made == [texts[0], "x" * 997 + "...", "é" * 997 + "..."]
    made = evaluate(spark, ["y" * 500, "y" * 501], lambda c: fc.truncate(c, 500, 500, "~"))
    assert made == ["y" * 500, "y" * 500 + "~"]


def test_parse_verdict(spark):
    texts = [
        "because\nYES", "because\n no ", "x\nYES NO", "x\nNOT SURE", "It should be replaced. YES\nmaybe",
        "should be replaced\nmaybe", "yes\n\n",
    ]
    assert evaluate(spark, texts, fc.parse_verdict) == [True, False, False, False, True, False, True]


def test_quality_signs(spark):
    texts = ["# x\n\n- **TODO:** Write a meaningful README.md", "[a](http://b)", None, "# real\n\nA long text here."]
    made = evaluate(
        spark, texts,
        lambda c: F.array_compact(
            F.array(*[F.when(v, F.lit(k)) for k, v in fc.quality_signs(c).items()])
        ),
    )
    assert made[0] == ["todo_marker", "template_instruction"]
    assert made[1] == ["very_short", "one_line", "only_a_link"]
    assert made[2] == ["very_short", "one_line"]
    assert made[3] == []


def test_text_builders(spark):
    one = evaluate(spark, ["a"], lambda c: ft.watermark(c, "2024-01-31", "m"))
    assert one == ["a\n\n###### AI Generated README\nGenerated on 2024-01-31 | Model: m"]
    assert evaluate(spark, ["p"], lambda c: ft.fenced_block(c, F.lit("t"))) == ["### p\n```\nt\n```\n\n"]
    lists = [["a", "b"], []]
    assert evaluate(spark, lists, lambda c: ft.bullet_lines(c, "None"), "array<string>") == [
        "- a\n- b", "None",
    ]
    long = [["a", "b", "c"], ["a"]]
    assert evaluate(
        spark, long, lambda c: ft.cap_with_overflow(c, 2, "... and %d more"), "array<string>"
    ) == [["a", "b", "... and 1 more"], ["a"]]
    assert evaluate(spark, [True, False], lambda c: ft.flag_sentence(c, "Yes."), "boolean") == ["Yes.", ""]


def test_render_template_is_sequential(spark):
    made = evaluate(
        spark, ["v ${b}"], lambda c: ft.render_template("${a} ${b} ${c}", {"a": c, "b": F.lit("$1"), "c": F.lit(None).cast("string")})
    )
    assert made == ["v $1 $1 "]


def test_artifact_name(spark):
    made = evaluate(spark, [3, 9], lambda c: ft.artifact_name("output", F.lit("r"), c, "m"), "int")
    assert made == ["step_03_draft-readme_output_r_m.md", "step_09_step-9_output_r_m.md"]
