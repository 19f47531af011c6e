import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repoatlas.functions import batches
from repoatlas.llm import ann, embedding_dedup, ngram_join, queries
from repoatlas.llm.ann import nearest_neighbours
from repoatlas.llm.components import connected_components

SF = "/root/testdata/sf0.01"


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_connected_components(spark, kind):
    rng = random.Random(2)
    links = {
        "chain": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(50)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "none": [(3, 3)],
    }[kind]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == components(nodes, [(a, b) for a, b in links if a != b])


# --- vectors ---------------------------------------------------------------------------------

def odd_vectors(n=400, dim=8):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        if i % 3 and i:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=dim) * 0.25
        rows.append((i, v.tolist(), i % 5))
    rows += [(n + i, rows[7][1], 0) for i in range(30)]
    rows += [(n + 30, [2 * x for x in rows[7][1]], 0), (7, rows[7][1], 0)]
    bad = [None, [0.0] * dim, [float("nan")] * dim, [1.0] * 3, [], [None] * dim, [float("inf")] + [1.0] * (dim - 1)]
    return rows + [(1000 + i, v, 0) for i, v in enumerate(bad)], bad


@pytest.mark.parametrize("block", [2048, 37])
def test_near_duplicate_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows, bad = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int")
    good = [(i, np.array(v)) for i, v, _ in rows if i < 1000]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    mask = x @ x.T >= 0.9
    np.fill_diagonal(mask, False)
    ids = [i for i, _ in good]
    roots = components(set(ids), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(mask))])
    want = sorted((i, int(n), roots[i], roots[i] == i) for i, n in zip(ids, mask.sum(axis=1)))
    want += [(1000 + i, 0, 1000 + i, True) for i in range(len(bad))]
    got = embedding_dedup.near_duplicates(df)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_are_written_once_whatever_cells_they_are_compared_with(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64)).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    written, save = [], embedding_dedup.save_table

    def saved(part, *folder):
        plan = part._jdf.queryExecution().executedPlan().toString()
        out = save(part, *folder)
        written.append((plan, sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())))
        return out

    monkeypatch.setattr(embedding_dedup, "save_table", saved)
    assert embedding_dedup.near_duplicates(df).filter("n_links = 0 AND kept").count() == len(x)
    assert not any("explode" in plan for plan, _ in written)
    assert sum(size for _, size in written) < 2 * x.nbytes


def test_a_vector_has_one_home_in_whatever_batch():
    rng = np.random.default_rng(9)
    centroids = rng.normal(size=(40, 8))
    centroids /= np.linalg.norm(centroids, axis=1)[:, None]
    centroids[[7, 31]] = centroids[3]
    x = np.concatenate([rng.normal(size=(300, 8)), centroids[3] * 2 + rng.normal(size=(100, 8)) * 1e-3])
    want = embedding_dedup.homes(x, centroids)
    assert (want[300:] == 3).all() and not np.isin(want, [7, 31]).any()
    assert all((embedding_dedup.homes(x[i : i + n], centroids) == want[i : i + n]).all() for n in (1, 7) for i in range(0, 400, n))


def test_margin_of_cells_loses_links_but_makes_none(spark):
    rows, _ = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int")
    links = lambda margin: {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, margin=margin).distinct().collect()}
    every, few = links(None), links(0.0)
    assert links(2.0) == every and few.keys() == every.keys() and all(few[i] <= every[i] for i in few)


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_labels_of_a_block_keep_what_earlier_chunks_joined(chunk):
    rng = np.random.default_rng(6)
    for turn in range(20):
        x = rng.normal(size=(24, 3))
        x /= np.linalg.norm(x, axis=1)[:, None]
        ids = rng.permutation(24).astype(np.int64)
        rows, cols = slice(0, 12), slice(12, 24)  # the columns visit, none is a row
        block = {"id": ids[rows], "x": x[rows], "n": np.ones(12, np.int64), "goes": np.zeros((12, 2), bool)}
        visitors = {"id": ids[cols], "x": x[cols], "n": np.ones(12, np.int64), "home": np.ones(12, np.int32)}
        got = embedding_dedup.compare_block(block, visitors, 0, 0.8, chunk)
        linked = np.argwhere(x[rows] @ x[cols].T >= 0.8)
        links = [(int(ids[a]), int(ids[12 + b])) for a, b in linked]
        edges = list(zip(got["vec_id"].tolist(), got["label"].tolist()))
        assert components(ids.tolist(), edges) == components(ids.tolist(), links), turn
        counts = defaultdict(int)
        for i, n in zip(got["vec_id"].tolist(), got["links"].tolist()):
            counts[i] += n
        assert all(counts[i] == sum(i in pair for pair in links) for i in ids.tolist())


def brute_nearest(rows, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.stack([v for _, v in rows])
    out = {}
    for q, v in rows:
        if q % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_neighbours_of_odd_vectors(spark):
    rows, _ = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    good = [(i, np.array(v)) for i, v, _ in rows if i < 1000]
    seen, unique = set(), []
    for i, v in good:  # the repeated row is one candidate
        if i not in seen:
            unique.append((i, v))
        seen.add(i)
    want = brute_nearest(unique)
    got = defaultdict(dict)
    for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(v) == list(range(1, 11)) for v in got.values())
    hits = sum(got[q][i + 1][0] == w[0] for q, ws in want.items() for i, w in enumerate(ws))
    assert hits / sum(map(len, want.values())) > 0.9
    few = nearest_neighbours(df.filter("vec_id IN (0, 3, 100, 1001)"), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (100, 1), (100, 2)]
    assert nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


def test_every_length_and_size_of_vectors_takes_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e200, 0.0]), (2, [2e200, 0.0]), (3, [1e-200, 1e-210]), (4, [5e-324, 0.0]), (5, [0.0, 1.7e308]),
            (6, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0]), (8, [2.0, 4.0, 6.1]), (9, [0.0, 0.0, 1e-300]), (10, [1.0]), (11, [-1.0]), (12, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (4, 0) for i in range(5)} | {5: (0, 5)} | {i: (2, 6) for i in (6, 7, 8)} | {9: (0, 9), 10: (0, 10), 11: (0, 11), 12: (0, 12)}
    near = nearest_neighbours(df, F.col("vec_id") % 6 == 0, k=3).collect()
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in near}
    assert found[6, 1] == (7, 0.0) and found[6, 2][0] == 9 and found[6, 3][0] == 8 and (6, 4) not in found and (12, 1) not in found
    assert found[0, 1][0] in (3, 4) and found[0, 3][0] == 1 and found[0, 3][1] == pytest.approx(1e200)
    big = spark.createDataFrame([(0, [3e200, 0.0]), (1, [0.0, 4e200]), (2, [3e200, 1e190])], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r.score for r in nearest_neighbours(big, F.col("vec_id") == 0).collect()}
    assert rows == {2: pytest.approx(1e190), 1: pytest.approx(5e200)}
    small = spark.createDataFrame([(0, [3e-250, 0.0]), (1, [0.0, 4e-250])], "vec_id long, embedding array<double>")
    assert [r.score for r in nearest_neighbours(small, F.col("vec_id") == 0).collect()] == [pytest.approx(5e-250)]


def test_recall_on_whole_table(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_nearest(rows)
    got = defaultdict(list)
    for r in queries.QUERIES["op4_nearest_neighbours"](spark, SF).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    exact = dict(rows)
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(s == pytest.approx(np.linalg.norm(exact[q] - exact[v]), abs=1e-12) for _, v, s in found)
    hits = sum(len({v for v, _ in want[q]} & {v for _, v, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_queries_of_a_group_are_dealt_over_lots(spark, monkeypatch):
    shape = "g long, vec_id long, asks boolean"
    placed = spark.createDataFrame([(i % 2, i, False) for i in range(20)], shape)
    asks = spark.createDataFrame([(0, i, True) for i in range(300)] + [(1, 5, True)], shape)
    lots = defaultdict(lambda: ([], []))
    for r in ann._dealt(placed, asks, 10).collect():
        lots[r.g, r.lot][r.asks].append(r.vec_id)
    assert len(lots) == 31 and max(len(q) for _, q in lots.values()) <= 30
    assert sorted(x for (g, _), (_, q) in lots.items() if g == 0 for x in q) == list(range(300))
    assert all(sorted(index) == list(range(g, 20, 2)) for (g, _), (index, _) in lots.items())

    rows, _ = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    whole = sorted(map(tuple, nearest_neighbours(df, F.lit(True)).collect()))
    monkeypatch.setattr(ann, "ASKS", 40)  # 431 queries in one group
    assert sorted(map(tuple, nearest_neighbours(df, F.lit(True)).collect())) == whole


# --- n-gram join -----------------------------------------------------------------------------

def brute_groups(rows, percent, words):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    ids = [i for i, _ in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((ids[a], ids[b]))
    return [len(s) for s in sets], components(set(ids), links)


def near_copies(seed=0, groups=12, hot=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 5)))
    passage = [word() for _ in range(12)]
    texts = [None, "", " \n", "A b", "a  B", "one two three", "One two\tthree four", "É x y z", "é x y z"]
    for g in range(groups):
        base = [word() for _ in range(rng.choice([4, 6, 7, 8, 13, 20, 45, 200, 700]))] + passage * (g % 2)
        for _ in range(hot if g == 0 else rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.randrange(0, 2 + len(own) // 40)):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own.insert(rng.randrange(len(own)), word())
            texts.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,percent,words", [(0, 85, 4), (1, 80, 5), (2, 85, 4), (3, 80, 5)])
def test_groups_equal_brute_force(spark, seed, percent, words):
    rows = near_copies(seed)
    sizes, roots = brute_groups(rows, percent, words)
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, n long").repartition(5)
    got = sorted(map(tuple, ngram_join.similar_groups(df, percent, words).collect()))
    assert got == [(i, n, roots[i]) for (i, _), n in zip(rows, sizes)]


@pytest.mark.parametrize("boundary", [0, 30, 10_000])
def test_any_boundary_and_long_lists_give_the_same_groups(spark, monkeypatch, boundary):
    monkeypatch.setattr(ngram_join, "best_boundary", lambda *_: boundary)
    rows = [(i, t) for i, t in near_copies(7, hot=90) if len(t or "") < 700]
    sizes, roots = brute_groups(rows, 85, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.similar_groups(df).collect()))
    assert got == [(i, n, roots[i]) for (i, _), n in zip(rows, sizes)]


def test_groups_of_odd_rows(spark):
    df = spark.createDataFrame(
        [(None, "a b c d"), (None, None), (3, "a b c d"), (3, "a b c d"), (2, "x " * 30_000), (5, "x " * 40_000)],
        "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect())
    assert got == [("2", 1, 2), ("3", 1, 3), ("3", 1, 3), ("5", 1, 2), ("None", 0, None), ("None", 1, None)]
    assert ngram_join.similar_groups(df.limit(0)).count() == 0


def row_groups(rows, percent, words):
    """Component of every id where each row is a document and rows of one id are linked."""
    _, roots = brute_groups([(i, t) for i, (_, t) in enumerate(rows)], percent, words)
    least = {}
    links = [(i, roots[i]) for i in roots]
    first = {}
    for i, (doc, _) in enumerate(rows):
        links.append((i, first.setdefault(doc, i)))
    whole = components(set(range(len(rows))), links)
    for i, (doc, _) in enumerate(rows):
        least[whole[i]] = min(least.get(whole[i], doc), doc)
    return [least[whole[i]] for i in range(len(rows))]


@pytest.mark.parametrize("shift", [0, -(2**61), 2**62 + 10**6])
def test_rows_of_one_id_link_by_their_own_texts(spark, shift):
    word = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(10, word("a", 40)), (10, word("b", 40)), (20, word("a", 41)), (30, word("b", 41)), (40, word("c", 40)),
            (50, word("c", 41)), (50, word("d", 60)), (5, word("d", 61)), (7, word("e", 3)), (7, None), (7, word("e", 3)), (8, word("e", 3))]
    rng = random.Random(4)
    rows += [(60 + rng.randrange(30), t) for _, t in near_copies(3, groups=8, hot=60)]
    rows = [(i + shift, t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id) for r in ngram_join.similar_groups(df).collect()}
    assert got == {(i, root) for (i, _), root in zip(rows, row_groups(rows, 85, 4))}
    assert (30 + shift, 10 + shift) in got and (50 + shift, 5 + shift) in got


def test_texts_are_shuffled_and_not_their_sets(spark, monkeypatch):
    compared, save = [], ngram_join.save_table

    def saved(df, folder=None):
        if folder and folder.endswith("/links") and not folder.endswith("/3/links"):
            compared.append(df._jdf.queryExecution().optimizedPlan().toString())
        return save(df, folder)

    monkeypatch.setattr(ngram_join, "save_table", saved)
    rows = [(i, t) for i, t in near_copies(7, groups=3, hot=30) if len(t or "") < 700]
    _, roots = brute_groups(rows, 85, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(df).collect()}
    assert got == {i: roots[i] for i, _ in rows}
    assert compared and not any("elements" in plan for plan in compared)


def test_key_pairs_and_lists_miss_no_similar_sets():
    rng = np.random.default_rng(1)
    for boundary in (0, 10, 25, 100):
        order = ngram_join.Order(np.zeros(1 << 10, np.int64), boundary, 1e9, 85)
        for _ in range(200):
            n = int(rng.integers(6, 40))
            a = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - len(a) // 14]],
                                          rng.integers(0, 1 << 40, rng.integers(0, 3)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if ngram_join.similar(both, len(a), len(b), 85) and both < max(len(a), len(b)):
                assert set(order.keys(a)[0].tolist()) & set(order.keys(b)[0].tolist())


def test_a_worker_keeps_a_table_until_another_kind_of_task(monkeypatch):
    monkeypatch.setattr(batches, "_kept", {})
    words = batches.kept(("words", 1), dict)
    batches.give_back(("words", 1))
    assert batches.kept(("words", 1), dict) is words
    batches.give_back()
    assert not batches._kept
    other = batches.kept(("words", 2), dict)
    batches.kept(("words", 1), dict)
    assert batches.kept(("words", 2), dict) is not other and len(batches._kept) == 1


# --- pipeline --------------------------------------------------------------------------------

ODD = [
    (1, "the thing and the other", "en", "a", 1, 9), (2, None, None, None, None, 9), (3, "123 456", "en", "a", 7, 9),
    (4, "le token=abcdefgh12345678 de la", "fr", None, 3, 9), (4, "une autre ligne du texte", "fr", "b", 3, 9),
    (None, "der die das und nicht", "de", "c", 3, 9), (6, "the thing and the other", "en", "b", 1, 9), (7, "w " * 50_000, "en", "a", 0, 9),
]


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, score int").withColumn("secret_spans", F.lit(1))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for rows in (docs, docs.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            if name != names[-1]:
                assert out.columns == docs.columns
                out = spark.createDataFrame(out.collect(), docs.schema)
            now = out
        count = now.count()
        assert count == 0 if rows is not docs else count > 0


def test_names_of_other_columns_may_be_any(spark):
    names = ["_kinds", "_found_id", "_id", "_n", "_k", "_words", "_take", "_takes", "_whole", "_runs", "_gone", "_found",
             "_score", "c0", "shard", "block", "_Spans", "_own_text"]
    rows = [(i, "le token=abcdefgh12345678 et la suite de la phrase " + "mot " * i, "fr", "ab"[i % 2], 0) for i in range(12)]
    rows += [(None, "the secret: abcdefgh12345678 and the other", "en", "a", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain = docs
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(i))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out, want = stage(spark, docs, SF), stage(spark, plain, SF)
        assert out.columns == docs.columns and {tuple(r) for r in out.select(*names).collect()} == {tuple(range(len(names)))}
        key = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
        assert key(out) == key(want)
        docs, plain = (spark.createDataFrame(x.collect(), x.schema) for x in (out, want))


def test_pipeline_stages_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = stages["language_id"](spark, docs, SF)
    kept_ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert all(not any(map(str.isalpha, t or "")) for i, t in texts.items() if i not in kept_ids)
    rows = sorted(texts.items())[:400]
    few = docs.filter("doc_id < 400")
    _, roots = brute_groups(rows, 80, 5)
    got = {r.doc_id for r in stages["ngram_jaccard_join"](spark, few, SF).collect()}
    assert got == {i for i in roots if roots[i] == i}
    clean = stages["secret_scan"](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in clean) == sorted(texts)
    changed = [r for r in clean if r.text != texts[r.doc_id]]
    assert changed and all("[SECRET]" in r.text and r.n_chars == len(r.text) for r in changed)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    by_seq = defaultdict(list)
    for r in out:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_join_takes_hashed_ids(spark):
    ids = [2**62 + 5, -(2**61), 2**40, 7]
    text = "one two three four five six seven eight nine ten"
    rows = [(ids[0], text), (ids[1], text + " eleven"), (ids[2], "quite other words in this text"), (ids[3], "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(df, percent=80).collect()}
    assert got == {ids[0]: ids[1], ids[1]: ids[1], ids[2]: ids[2], ids[3]: 7}
