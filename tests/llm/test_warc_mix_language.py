import io
import re
import struct
import zipfile
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repoatlas.llm import language, mix, queries, warc

SF = "/root/testdata/sf0.01"


# --- web archives ----------------------------------------------------------------------------

def test_archive_round_trip(spark, tmp_path):
    big, other = "x" * 200 + "é", "y" * 100
    rows = [
        (5, "u5", big, 1), (3, "u3", big, 1), (9, None, big, 1), (3, "again", big, 1), (1, "a b\n", None, 1),
        (2, "", "", 1), (7, "s", "short", 1), (8, "s", "short", 1), (10, "z", other, 1), (None, "n", other, 1),
        (11, "l", "long " * 400_000, 1), (12, "crlf", "a\r\n\r\nb" * 30, 1),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int").repartition(3)
    packages = warc.archive_pages(df, str(tmp_path))
    assert packages.agg(F.sum("n_records")).first()[0] == len(rows)
    got = sorted(warc.read_archives(packages).collect(), key=lambda r: (str(r.page_id), r.url))
    want = {}
    for page, url, html, _ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, _ in rows if h == html and p is not None and len(data) >= 100]
        first = min(same) if same else None
        want.setdefault(page, []).append((len(data), sha256(data).hexdigest(), None if first == page else first))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == Counter(
        (p, *v) for p, values in want.items() for v in values
    )
    for r in got:
        assert (r.record_type == "revisit") == (r.refers_to is not None)
        if r.record_type == "response":
            assert sha256(r.payload).hexdigest() == r.payload_digest
    empty = warc.archive_pages(df.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(empty).count() == 0


def test_zip_directories_agree_with_the_standard_library():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05 a comment"
        z.writestr("a/b.txt", b"hello" * 10)
        z.writestr("packed", b"z" * 100, zipfile.ZIP_DEFLATED)
        z.writestr("c", b"")
        z.writestr("é", b"last")
    raw = data.getvalue()
    members = warc.zip_members(pa.BufferReader(raw), len(raw))
    assert {n: raw[a : a + k] for n, (a, k) in members.items()} == {"a/b.txt": b"hello" * 10, "c": b"", "é": b"last"}
    with pytest.raises(ValueError):
        warc.zip_members(pa.BufferReader(b"no zip at all" * 9), 117)


def test_zip64_directories():
    """A package whose sizes and offsets stand in the 64-bit fields only."""
    name, body = b"archive/data", b"payload"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 7, 7, len(name), 4) + name + b"\0\0\0\0" + body
    extra = struct.pack("<HHQQQ", 1, 24, 7, 7, 0)
    central = b"PK\x01\x02" + struct.pack(
        "<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF
    ) + name + extra
    wide = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, len(local) + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = local + central + wide + locator + end
    ((found, (at, n)),) = warc.zip_members(pa.BufferReader(raw), len(raw)).items()
    assert (found, raw[at : at + n]) == ("archive/data", body)


# --- mixing ----------------------------------------------------------------------------------

def brute_targets(sizes, weights, most=3):
    total, share, full = sum(sizes), {}, set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        w = sum(weights[i] for i in open_)
        share = {i: most * sizes[i] if i in full else rest * weights[i] / w for i in range(len(sizes))}
        over = [i for i in open_ if share[i] > most * sizes[i]]
        if not over:
            return [share[i] for i in range(len(sizes))]
        full |= set(over)


@pytest.mark.parametrize("sizes", [[10], [1, 1000, 50], [5, 5, 5000, 1], [0, 7, 100], [0, 0], [3] * 20])
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mix.target_sizes(sizes, weights, sum(sizes), 3)
    assert np.allclose(got, brute_targets(sizes, weights))
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * n + 1e-9 for t, n in zip(got, sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(n):
    for key in (0, 12345):
        got = mix.permuted(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(got.tolist()) == list(range(n))


def test_mix_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op3_mixing_sources"](spark, SF).collect()
    again = queries.QUERIES["op3_mixing_sources"](spark, SF).collect()
    assert sorted(rows) == sorted(again)
    source = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in docs.collect()}
    by_source = {}
    for r in rows:
        name, size = source[r.doc_id]
        assert r.size == size and 0 <= r.taken <= 3 * size
        by_source.setdefault(name, []).append(r)
    order = sorted(by_source)
    sizes = [sum(r.size for r in by_source[s]) for s in order]
    want = brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, size, target in zip(order, sizes, want):
        assert {(r.source_size, round(r.target, 4)) for r in by_source[s]} == {(size, round(target, 4))}
        assert abs(sum(r.taken for r in by_source[s]) - target) < 0.02 * target


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i % 40, " ".join(f"w{i}_{j}" for j in range(i * 3)), "en", ["a", "b", None, "d"][i % 4], 1, i) for i in range(60)]
    rows += [(100, None, None, "a", 0, 0), (101, " \n", None, "b", 0, 0), (None, "one two", None, None, 7, 0), (7, rows[7][1], "en", "d", 1, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, epoch int")
    m = mix.mix_sources(df, block_words=8, shard_slots=16)
    taken = m.taken().collect()
    assert len(taken) == len(rows)
    out = mix.mixed_documents(df, m)
    assert out.columns == df.columns
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    for r in taken:
        want[r.doc_id] += r.taken
        assert r.taken <= 3 * r.size
    assert got == +want
    assert mix.mix_sources(df.limit(0)).taken().count() == 0
    assert mix.cut_words("a  b\nc d e", [(0, 2), (2, 1), (4, 1)]) == "a  b\nc\n\ne"


def test_slots_and_pieces_are_never_broadcast(spark):
    """Spark takes both for as small as the tables they are made of, whatever their number."""
    df = spark.createDataFrame([(i, "a b c d e " * 40, f"s{i % 3}", 400) for i in range(50)],
                               "doc_id long, text string, source string, n_chars int")
    m = mix.mix_sources(df, block_words=8, shard_slots=16)
    for out in (m.taken(), m.content(), mix.mixed_documents(df, m)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"(\w+Join) \[[^]]*(?:block|_start|_id)#", plan)
        assert joins and set(joins) == {"SortMergeJoin"}, joins



# --- language --------------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op8_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    own = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(own) / len(own) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(300)
    other = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = language.fit_language(docs), language.fit_language(other)
    assert a.languages == b.languages and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_language_of_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit_language(docs.limit(200))
    odd = [(1, None, "q"), (2, "", "q"), (3, "123 \n!?", "q"), (4, "é", "q"), (None, "\x00\x00a", "q"), (6, "x" * 200_000, "q")]
    df = spark.createDataFrame(odd, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language.identify_language(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert all(got[i].lang_pred in model.languages for i in (4, None, 6))
    assert language.identify_language(df.limit(0), model).count() == 0
    none = language.fit_language(docs.limit(0))
    assert {r.lang_pred for r in language.identify_language(df, none).collect()} == {"und"}


def test_ngrams_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["ab", "", "abcé", "z"]
    slots, starts = language.ngram_slots(texts)
    for i, t in enumerate(texts):
        own, _ = language.ngram_slots([t])
        part = slots[:, starts[i] : starts[i] + own.shape[1]]
        assert (part == own).all() and (own >= 0).sum() == sum(max(0, len(t) - n + 1) for n in language.ORDERS)


def test_language_sample_is_bounded_for_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_CHUNKS", 4)
    monkeypatch.setattr(language, "PER_CHUNK", 2)
    word = lambda i: "".join(chr(97 + int(d)) for d in str(1000 + i))
    rows = [(None, f"null {word(i)}", "a") for i in range(60)] + [(7, f"seven {word(i)}", "b") for i in range(60)]
    rows += [(9, "copies of one text", "c")] * 40
    found = language._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    number = {lang: [n for own, n, *_ in found if own == lang] for lang in "abc"}
    assert number == {"a": list(range(8)), "b": list(range(8)), "c": [0]}
    assert len({(lang, slots.tobytes()) for lang, _, slots, _ in found}) == 17
