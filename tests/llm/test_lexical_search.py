import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from repoatlas.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k):
    counts = [(doc, Counter(terms_of(text))) for doc, text in docs]
    counts = [(doc, c) for doc, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for query, text in queries:
        asked.setdefault(query, set()).update(terms_of(text))
    out = set()
    for query, terms in asked.items():
        found = []
        for doc, c in counts:
            m = 50 + 50 * c.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in terms if c[t]
            )
            if score > 0:
                found.append((-score, doc is not None, doc or 0))
        out |= {(query, rank, doc if there else None, -score) for rank, (score, there, doc) in enumerate(sorted(found)[:k], 1)}
    return out


def corpus(n=400, seed=4):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "été", "ÉTÉ", "x1", "1", "日本"] + [f"w{i}" for i in range(60)]
    weights = [60, 20, 40, 10, 5, 5, 5, 5] + [1] * 60
    join = [" ", ", ", "\n", "-", "\x00", "\x7f", "_"]
    text = lambda n: "".join(w + rnd.choice(join) for w in rnd.choices(words, weights, k=n))
    docs = [(rnd.choice([None, *range(300)]), rnd.choice([None, "", " ,;", text(rnd.randrange(1, 60))]) if i % 5 == 0 else text(rnd.randrange(1, 60))) for i in range(n)]
    docs += [docs[1]] * 3 + [(1000 + i, "the same text w1") for i in range(80)] + [(5000, text(20_000))]
    queries = [(i, text(rnd.randrange(1, 25))) for i in range(30)]
    queries += [(3, "w59 w58"), (None, "w1 w2"), (None, "w3"), (40, None), (41, ""), (42, "nowhere"), (43, "the the The same")]
    return docs, queries


@pytest.mark.parametrize("tasks, shard, bundle, k", [(1, 1 << 14, 128, 10), (6, 16, 5, 50), (3, 7, 1, 1)])
def test_ranks_equal_scoring_every_document(spark, monkeypatch, tasks, shard, bundle, k):
    monkeypatch.setattr(ls, "BUNDLE", bundle)
    monkeypatch.setattr(ls, "SHARDS_TOGETHER", 4)
    docs, queries = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(tasks)
    q = spark.createDataFrame(queries, "item_id long, text string").repartition(tasks)
    for clash in ("term", "shard", "query", "score", "rank", "lot"):
        d, q = d.withColumn(clash, F.lit("x")), q.withColumn(clash, F.lit("x"))
    found = ls.ranked_search(d, q, k, shard_docs=shard)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len({r[:2] for r in rows}) and set(rows) == brute(docs, queries, k)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert ls.ranked_search(d, q).count() == 0
    assert [r.score for r in ls.ranked_search(docs, items).collect()] == [2 * 287 * (10**9 // 3000)]


def test_long_texts_are_cut_at_terms(monkeypatch):
    text = ("abc Ünï " * 50 + "x" * 300 + " end").encode()
    whole = ls.term_counts(text)
    for part in (1, 7, 64):
        monkeypatch.setattr(ls, "PART", part)
        assert ls.term_counts(text) == whole == Counter(t.encode() for t in terms_of(text.decode()))


def test_no_accumulator_that_may_win_is_dropped():
    scores = np.array([0, 5, 9, 9, 1, 4])
    assert ls.hopeful(scores, 2, 0).tolist() == [2, 3]
    assert ls.hopeful(scores, 2, 4).tolist() == [1, 2, 3]
    assert ls.hopeful(scores, 2, 100).tolist() == [1, 2, 3, 4, 5]
    assert ls.hopeful(scores, 9, 0).tolist() == [1, 2, 3, 4, 5]


def test_a_common_term_is_split_over_shards(spark):
    """The join of lists and queries has the lot of shards in its key, and nothing is crossed."""
    docs = spark.createDataFrame([(i, "the w") for i in range(100)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    plan = ls.ranked_search(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
