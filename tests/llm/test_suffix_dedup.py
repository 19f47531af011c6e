import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from repoatlas.llm import queries, suffix_dedup as sd

SF = "/root/testdata/sf0.01"


def brute(docs, length):
    """doc index -> (bytes, removed, spans, digest) by looking at every string."""
    seen = defaultdict(list)
    for i, text in enumerate(docs):
        for a in range(len(text) - length + 1):
            key = text[a : a + length] if len(docs) < 100 else hash(text[a : a + length])
            seen[key].append((i, a))
    gone = [bytearray(len(t)) for t in docs]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                gone[i][a : a + length] = b"\1" * length
    out = []
    for text, flags in zip(docs, gone):
        kept = bytes(b for b, f in zip(text, flags) if not f)
        spans = sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
        out.append((len(text), sum(flags), spans, sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_common_prefixes_of_small_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 5))]
        texts += [texts[0]] * rng.randrange(2)
        length = rng.randrange(1, 7)
        texts = [t for t in texts if len(t) >= length] or [b"a" * length]
        starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        got = sd.repeated_starts(texts, length)
        want = [[starts[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]
        assert [g.tolist() for g in got] == want


def test_prefix_values_are_exact():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abc") for _ in range(300)) * 2
    symbols = np.append(np.frombuffer(text, np.uint8).astype(np.int64) + 1, 0)
    order = sd.suffix_array(symbols, len(symbols))
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
    got = sd.common_prefixes(symbols, order, 40)
    for i in range(1, len(order)):
        a, b = symbols[order[i - 1] :], symbols[order[i] :]
        n = min(len(a), len(b))
        same = int((a[:n] != b[:n]).argmax()) if (a[:n] != b[:n]).any() else n
        assert got[i] == min(same, 40)


def test_only_suffixes_that_are_still_alike_are_sorted_again(monkeypatch):
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = [b" ".join(rng.choice(words) for _ in range(400)) for _ in range(20)]
    texts.append(texts[0][50:900])
    n = sum(len(t) + 1 for t in texts)
    moved, sort = [], np.argsort

    def counted(values, *args, **kwargs):
        moved.append(len(values) * (values.itemsize > 2))
        return sort(values, *args, **kwargs)

    def refused(keys):
        raise AssertionError("a sort by three keys")

    monkeypatch.setattr(sd.np, "argsort", counted)
    monkeypatch.setattr(sd.np, "lexsort", refused)
    found = sd.repeated_starts(texts, 400)
    assert [int(f.sum()) for f in found] == [451, *[0] * 19, 451]
    assert sum(moved) < 5 * n


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(3)
    text = bytes(rng.randrange(97, 100) for _ in range(3000)) + b"z" * 900
    h, place, lo, hi = sd.anchors(text)
    assert lo[0] == 0 and hi[-1] == len(text) - 400 and (lo[1:] == hi[:-1] + 1).all()
    for cut in (1, 333, 2999):
        h2, place2, lo2, hi2 = sd.anchors(text[cut:])
        start = {s: (int(x), p - s) for x, p, a, b in zip(h, place, lo, hi) for s in range(a, b + 1)}
        for x, p, a, b in zip(h2, place2, lo2, hi2):
            for s in range(a, b + 1):
                assert start[s + cut] == (int(x), p - s)
    assert len(sd.anchors(b"x" * 399)[0]) == 0


def rows_of(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def odd_documents():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    common, other = word(900), word(450)
    docs = [None, "", "x", word(399), word(5000), common, common, word(100) + common + word(50), common[:420] + word(9),
            other + word(300) + other, "z" * 3000, "ab" * 700, word(60_000) + common]
    base = word(1500)
    for _ in range(60):
        at = rng.randrange(1500)
        docs.append(base[:at] + "#" + base[at + 1 :])
    return [(i % 70 if i else None, t, 1) for i, t in enumerate(docs)] + [(5, common, 1)]


@pytest.mark.parametrize("block", [sd.BLOCK_BYTES, 4000, 1500])
def test_removal_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(sd, "BLOCK_BYTES", block)
    docs = odd_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string, spans int").repartition(4)
    want = brute([(t or "").encode() for _, t, _ in docs], 400)
    got = sd.remove_repeats(df)
    assert rows_of(got) == sorted((str(i), *w) for (i, _, _), w in zip(docs, want))
    for r in got.collect():
        assert sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_a_long_run_of_one_byte_is_one_row(spark):
    texts = ["z" * 400_000, "ab" + " " * 5000 + "cd", " " * 400, "x" * 400, "y" * 399, "q" * 401 + "r" * 900 + "q" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    places = sd.find_places(df).collect()
    assert len(places) < 3000 and sum(r.times for r in places if r.doc_id == 0) == 399_601
    assert len([r for r in places if r.doc_id == 0]) == 1
    want = brute([t.encode() for t in texts], 400)
    assert rows_of(sd.remove_repeats(df)) == sorted((str(i), *w) for i, w in enumerate(want))


def test_query_on_whole_table(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((str(i), *w) for (i, _), w in zip(docs, brute([t for _, t in docs], 400)))
    got = queries.QUERIES["op9_suffix_array_dedup"](spark, SF)
    assert rows_of(got) == want and any(w[2] for w in want)
    assert all(len(r.text.encode()) <= r.n_bytes - r.n_removed < len(r.text.encode()) + 8 * r.n_spans + 1 for r in got.collect())
