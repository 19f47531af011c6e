import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repoatlas.llm import byte_bpe, simple8b, token_files
from repoatlas.llm.queries import QUERIES, tokenizer_path
from repoatlas.llm.warc import open_store

SF = "/root/testdata/sf0.01"
BPE = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


# --- Simple-8b -------------------------------------------------------------------------------

widths = st.integers(0, 64).flatmap(lambda b: st.integers(0, (1 << b) - 1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(widths, st.integers(1, 300)), max_size=40))
def test_integers_of_any_width_come_back(runs):
    values = np.array([v for v, n in runs for _ in range(n)], np.uint64)
    words, escapes = simple8b.encode(values)
    assert simple8b.decode(words, escapes, len(values)).tolist() == values.tolist()
    assert len(escapes) == int((values >= 1 << 60).sum())


def test_words_hold_what_their_selector_says():
    words, escapes = simple8b.encode(np.array([0] * 240 + [1] * 60 + [50_000] * 3, np.uint64))
    assert words.tolist()[0] == 15 << 60 and words.tolist()[1] == 1 << 60 | (1 << 60) - 1
    assert words.tolist()[2] == 12 << 60 | 50_000 << 40 | 50_000 << 20 | 50_000 and not len(escapes)
    words, escapes = simple8b.encode(np.array([1 << 63, 1], np.uint64))
    assert words.tolist() == [0, 1 << 60 | 1] and escapes.tolist() == [1 << 63]


def test_packing_takes_the_most_that_fits():
    rnd = random.Random(3)
    values = [rnd.getrandbits(rnd.choice([0, 1, 3, 9, 16, 31, 60])) for _ in range(5000)]
    at = n_words = 0
    order = [15, *range(1, 15)]
    while at < len(values):
        fit = [s for s in order if all(v < 1 << simple8b.LAYOUTS[s][1] for v in values[at : at + simple8b.LAYOUTS[s][0]])]
        at += max(simple8b.LAYOUTS[s][0] for s in fit)
        n_words += 1
    assert len(simple8b.encode(np.array(values, np.uint64))[0]) == n_words


def test_a_wrong_number_is_an_error():
    words, escapes = simple8b.encode(np.arange(40, dtype=np.uint64))
    for n in (1, 1000):
        with pytest.raises(ValueError):
            simple8b.decode(words, escapes, n)


# --- ids of texts ----------------------------------------------------------------------------

HOSTILE = [
    "", " ", "\n", "  a", "a  ", "a\n\nb", "a \nb", "a\n b", "a\tb c", "it's don't, we'll: x'S", "x.\ny,\nz",
    "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>,b <|endoftext", "é. è, ü; İ. ß! ᾳ: ǅ. ª, 9. 9,9 ²! ٣.",
    "a b c　 d", "\x1c a \x1f. b\x85c ​ d᠎ e", "क्षि। हिन्दी, ก็. 日本。 日, 🙂. 🙂🙂, ퟿",
    ". , ;; !?. ...", "a.,;b .c ,d", "word" * 2000 + ".", "a\r\nb\r\n c", "'s 't", "\n a", "a \n", "x " * 3000, "",
]


def test_ids_equal_the_tokenizers(tokenizer):
    rnd = random.Random(1)
    pool = ["a", "Ab", "é", "ß.", "İ", "9", " ", "  ", "\n", "\n\n", "\t", ",", ".", "'s", "'", "<|endoftext|>",
            "日", "क्", " ", "\x1c", "\x85", "​", "🙂", "_", "!?", "ﬁ", "́", "x" * 50]
    texts = HOSTILE + ["".join(rnd.choices(pool, k=rnd.randrange(1, 12))) for _ in range(20_000)]
    known = byte_bpe.TextIds(BPE)
    assert known.by_units
    for i in range(0, len(texts), 400):
        part = texts[i : i + 400]
        for text, pieces in zip(part, known.encode(part)):
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(b"".join(pieces), "<u4").tolist() == want, repr(text)


def test_letters_and_endings_of_all_code_points(tokenizer):
    known = byte_bpe.TextIds(BPE)
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}{e} b{e}{c} {c}{e}\n{c}a" for c in points for e in ".:"]
    for i in range(0, len(texts), 1000):
        part = texts[i : i + 1000]
        want = [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(b"".join(p), "<u4").tolist() for p in known.encode(part)] == want


def test_long_texts_are_taken_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART", 50)
    monkeypatch.setattr(byte_bpe, "CACHED_UNITS", 20)
    known = byte_bpe.TextIds(BPE)
    rnd = random.Random(2)
    texts = ["".join(rnd.choices(["a", "bc", " ", "\n", ". ", "é", "  ", "<|endoftext|>", "x" * 60], k=300)) for _ in range(60)]
    for text, pieces in zip(texts, known.encode(texts)):
        assert np.frombuffer(b"".join(pieces), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_files_get_whole_texts():
    with open(BPE, encoding="utf-8") as file:
        spec = json.load(file)
    assert byte_bpe.cuts_at_spaces(spec)
    assert not byte_bpe.cuts_at_spaces(spec | {"normalizer": {"type": "NFC"}})
    assert not byte_bpe.cuts_at_spaces(spec | {"pre_tokenizer": {"type": "Whitespace"}})
    assert not byte_bpe.cuts_at_spaces(spec | {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}})
    word = byte_bpe.TextIds(tokenizer_path("word_bpe_49k.json"))
    assert not word.by_units
    want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode("Some İ. text", add_special_tokens=False).ids
    assert np.frombuffer(b"".join(next(iter(word.encode(["Some İ. text"])))), "<u4").tolist() == want


# --- files -----------------------------------------------------------------------------------

def brute(rows, tokenizer, end_id):
    at, out = 0, []
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_the_tokenizer(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute(sorted((r.doc_id, r.text) for r in docs), tokenizer, 2)
    got = QUERIES["op12_token_output"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_odd_rows_and_many_files(spark, tokenizer, tmp_path):
    rows = [(i % 9 - 3 if i % 5 else None, t) for i, t in enumerate(HOSTILE * 2)] + [(4, None), (4, "x"), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.withColumn("_hash", F.lit("x")).withColumn("path", F.lit(1)).withColumn("n_tokens", F.lit(1))
    files = token_files.write_token_files(df, f"file://{tmp_path}/t", BPE, 2, most_tokens=20)
    files = token_files.save_table(files)
    assert files.count() > 5
    got = token_files.read_token_files(files, keep_ids=True).collect()
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    key = lambda d: (d is not None, d or 0)
    assert sorted((key(r.doc_id), r.ids) for r in got) == sorted((key(d), ids(t)) for d, t in rows)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)]).tolist()[:-1]
    assert [key(r.doc_id) for r in got] == sorted(key(d) for d, _ in rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.n_tokens for r in got)


def test_no_rows_and_no_end(spark, tokenizer, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_token_files(token_files.encode_corpus(empty, BPE)).count() == 0
    one = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    got = token_files.read_token_files(token_files.encode_corpus(one, BPE)).orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens) for r in got] == [(0, 0), (0, 2)]


def test_any_range_of_a_file(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    rnd = np.random.default_rng(1)
    docs = [rnd.integers(0, 1 << int(b), int(n), np.uint32) for b, n in zip(rnd.integers(1, 32, 50), rnd.integers(0, 200, 50))]
    store, _ = open_store(str(tmp_path))
    writer = token_files.TokenWriter(store.open_output_stream(f"{tmp_path}/x"))
    for i, ids in enumerate(docs):
        writer.add(i or None, [ids[:10].tobytes(), ids[10:].tobytes()])
    writer.close()
    every = np.concatenate(docs)
    with store.open_input_file(f"{tmp_path}/x") as file:
        reader = token_files.TokenReader(file)
        assert len(reader.blocks) == -(-len(every) // 64)
        assert [d for d, _ in reader.documents()] == [None, *range(1, 50)]
        for first in range(0, len(every), 37):
            n = min(100, len(every) - first)
            assert reader.tokens(first, n).tolist() == every[first : first + n].tolist()
        with pytest.raises(ValueError):
            reader.tokens(len(every), 1)
    data = bytearray((tmp_path / "x").read_bytes())
    data[-100] ^= 1
    (tmp_path / "y").write_bytes(data)
    with store.open_input_file(f"{tmp_path}/y") as file, pytest.raises(ValueError, match="damaged"):
        token_files.TokenReader(file)


def test_a_repeated_unit_is_looked_for_once_before_it_is_learned():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    known = byte_bpe.TextIds(BPE)
    known.units = Counted()
    texts = ["the cat, the cat\nthe dog " * 200, "a  b the", "", "the"]
    for _ in range(2):
        found = [b"".join(pieces) for pieces in known.encode(texts)]
        assert found == [known.whole(t) if t else b"" for t in texts]
    assert Counted.asked < 100
