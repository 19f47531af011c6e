import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from repoatlas.llm import filter_audit

WHITE = "\t\n\x0b\x0c\r "


def words_of(text):
    out, word = [], ""
    for c in text + " ":
        if c in WHITE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    parts = {}
    for doc, text, lang in rows:
        text = text or ""
        words = words_of(text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            fails.add("C")
        if set(text) & set("#$%&*|"):
            fails.add("D")
        if any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, _ in rows):
            fails.add("E")
        parts.setdefault(lang or "", []).append((doc, fails))
    out = set()
    for part, docs in parts.items():
        removed_by = {}
        lines = []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d, fails in left if f in fails]
                earlier = sum(f in fails and bool(fails & set(order[: step - 1])) for _, fails in docs)
                left = [x for x in left if f not in x[1]]
                removed_by[f] = removed_by.get(f, 0) + len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), earlier,
                              sum(fails == {f} for _, fails in docs),
                              sum(d in good for d in gone), sum(d in toxic for d in gone), f))
        out |= {(*line[:-1], removed_by[line[-1]]) for line in lines}
    return out


def corpus():
    rnd = random.Random(5)
    texts = [None, "", "x", "a " * 300, "A# " * 200, "é" * 500, "\x1c  b", "w" * 100_000]
    texts += [" ".join(f"w{rnd.randrange(400)}" for _ in range(250)) + end for end in ("", " $", " ABCDEFGHIJKLMNOP" * 8)]
    langs = [None, "", "en", "fr"]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(texts), rnd.choice(langs)) for _ in range(150)]
    rows += [rows[3], rows[3], (7, texts[8], "en"), (7, texts[8], "fr")]
    labels = [(i, rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1])) for i in range(30)]
    return rows, labels + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]


COLUMNS = ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]


@pytest.mark.parametrize("tasks", [1, 7])
def test_audit_equals_applying_all_orders(spark, tasks):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(tasks)
    for clash in ("part", "mask", "n", "digest", "good", "quality"):
        docs = docs.withColumn(clash, F.lit("x"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit(1))
    got = [tuple(r) for r in filter_audit.audit_filters(docs, known).select(*COLUMNS).collect()]
    assert len(got) == len(set(got)) == 600 * 3
    assert set(got) == brute(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "Some text", None)], docs.schema)
    rows = filter_audit.audit_filters(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert {r.shapley for r in rows if r.filter_order[r.step - 1] in "AC"} == {60}


def test_one_text_travels_as_few_rows(spark):
    """Copies are added up before the shuffle: a row per task, part and mask."""
    rows = [(i, "en", 3, b"same") for i in range(4000)]
    masks = spark.createDataFrame(rows, "doc_id long, part string, mask int, digest binary")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = filter_audit.mask_cells(masks, labels)
    assert {(r.mask, r.n) for r in cells.collect()} == {(3, 1), (19, 3999)}
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
