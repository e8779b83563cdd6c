"""Encoding held against the tiktoken library, decoding against the texts themselves."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.catalog import op11_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string, word int, decoded int, n_chars long"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.Encoder(ranks, bpe.merge_table(ranks), PATTERN)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "?", 1, 2, 3) for i, t in rows], SCHEMA)


def texts():
    draw = random.Random(8)
    letters = [*"aAbzZ 's\t\n\r\x1c\x85\xa0 　é日本語١½²ⅷ😀é\0", "'ll", "'S", "  ", "the", "ing", " of", "<|endoftext|>"]
    made = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(1200)]
    alphabet = "etaoinshrdlu"
    words = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 60))) for _ in range(1500)]
    runs = ["a" * 700, "ab" * 400, " " * 99, "=" * 333, "日" * 300, "".join(draw.choice(alphabet) for _ in range(700))]
    return [*made, " ".join(words), *runs, "", "".join(map(chr, range(0x3000)))]


def split(ids, offsets):
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_texts_have_the_library_s_ids(encoder, library):
    given = texts()
    assert split(*encoder.encode(given)) == [library.encode_ordinary(t) for t in given]
    assert split(*encoder.encode(given)) == [library.encode_ordinary(t) for t in given]  # all words known
    assert split(*encoder.encode([])) == []


def test_slices_forgetting_and_few_rounds_change_nothing(encoder, library, monkeypatch):
    given = [*texts()[:150], "ab" * 200, "etaoinshrdlu" * 9, ""]
    monkeypatch.setattr(bpe, "_SLICE", 90)
    monkeypatch.setattr(bpe, "_POSITIONS", 100)
    monkeypatch.setattr(bpe, "_STATES", 800)
    monkeypatch.setattr(bpe, "_REMEMBERED", 3_000)
    assert split(*encoder.encode(given)) == [library.encode_ordinary(t) for t in given]


def test_vocabularies_in_which_a_merge_opens_a_lower_one():
    # "ab" has a higher rank than "abc", which it leads to: pairs of "ab" must go one at a time.
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"ca", b"aa", b"aab", b"bab", b"aaaa"]
    ranks = {t: i for i, t in enumerate(tokens)}
    library = tiktoken.Encoding("small", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, bpe.merge_table(ranks), PATTERN)
    draw = random.Random(2)
    given = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 30))) for _ in range(800)]
    assert split(*encoder.encode(given)) == [library.encode_ordinary(t) for t in given]


def test_a_vocabulary_without_a_byte():
    ranks = {b"a": 0, b"b": 1, b"ab": 2}
    encoder = bpe.Encoder(ranks, bpe.merge_table(ranks), PATTERN)
    assert split(*encoder.encode(["abb"])) == [[2, 1]]
    with pytest.raises(ValueError):
        encoder.encode(["abc"])


def test_decoding(ranks, library, monkeypatch):
    decoder = bpe.Decoder(ranks)
    given = texts()
    lists = [library.encode_ordinary(t) for t in given]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = np.concatenate(lists)
    assert decoder.decode(flat, offsets) == [t.encode() for t in given]
    monkeypatch.setattr(bpe, "_TOKENS", 7)
    assert decoder.decode(flat[: offsets[40]], offsets[:41]) == [t.encode() for t in given[:40]]
    with pytest.raises(ValueError):
        decoder.decode(np.array([50256]), np.array([0, 1]))


def test_tables(spark, library):
    long = " ".join(random.Random(5).choices(["wolf", "ran", "naïve", "12,5"], k=300_000))
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (7, None), (7, "again"), (7, "again"), (-1, long)]
    encoded = bpe.encode(frame(spark, rows).repartition(4), PATH, PATTERN)
    assert encoded.columns == ["doc_id", "ids"]
    want = sorted((str(i), library.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in encoded.collect()) == want
    decoded = bpe.decode(encoded.withColumn("text", F.lit(1)), PATH).collect()
    back = sorted((str(r["doc_id"]), r["n_tokens"], np.frombuffer(r["ids_le"], "<u4").tolist(), bytes(r["decoded"])) for r in decoded)
    assert back == sorted((str(i), len(x), x, (t or "").encode()) for i, t in rows for x in [library.encode_ordinary(t or "")])


def test_null_lists_and_no_rows(spark):
    lists = spark.createDataFrame([(1, None), (2, []), (3, [64])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: (r["n_tokens"], bytes(r["decoded"])) for r in bpe.decode(lists, PATH).collect()} == {
        1: (0, b""), 2: (0, b""), 3: (1, b"a"),
    }
    none = bpe.encode(frame(spark, []), PATH, PATTERN)
    assert none.count() == 0 and bpe.decode(none, PATH).count() == 0


def test_the_query(spark, library):
    import hashlib

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {}
    for r in docs:
        ids = library.encode_ordinary(r["text"] or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[r["doc_id"]] = (len(ids), digest, hashlib.sha256((r["text"] or "").encode()).hexdigest())
    found = op11_bpe(spark, sf_dir)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == want
