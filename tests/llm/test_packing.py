import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, part string, first int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "?", "?", 0) for i, t in rows], SCHEMA)


def test_encoder_gives_the_tokenizer_s_ids_for_any_text(tokenizer):
    draw = random.Random(4)
    letters = [*"aAbzZsStm'’.,-#1 9\t\né—ñ…ß́ 日本‍<|>Σς\x85\x1c☃😀\0", "'s", "'LL", "<|endoftext|>", "it's", "<|startoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(1500)]
    ids, offsets = packing.WordEncoder(PATH).encode(pa.array([*texts, None]))
    for text, a, b in zip([*texts, ""], offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END]


def test_names_of_added_tokens_have_their_ids(tokenizer):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|><|endoftext|>", "plain", "", "<|end oftext|>"]
    ids, offsets = packing.WordEncoder(PATH).encode(pa.array([*texts, None]))
    got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, packing.END] for t in [*texts, ""]]
    assert got[0] == [320, 49407, 321, packing.END]


def test_a_worker_stays_small():
    """What is remembered, and what one slice needs, is bounded however many texts come."""
    code = f"""
import random, resource, sys
import pyarrow as pa
from lodestone.llm import packing
draw = random.Random(1)
encoder = packing.WordEncoder({PATH!r})
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for _ in range(25):
    words = ["".join(draw.choices("etaoinshr", k=9)) for _ in range(100_000)]
    encoder.encode(pa.array([" ".join(words)]))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 200


def texts(n):
    draw = random.Random(n)
    vocabulary = ["the", "pack", "of", "wolves,", "ran", "thndering", "ñu.", "7", "ouest"]
    rows = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 5, 60, 400])))) for i in range(n)]
    return [*rows, (n, None), (n + 1, "a b " * 3000), (3, rows[3][1])]


def test_pieces_cover_each_document_once_and_leave_no_gap(spark, tokenizer):
    rows = texts(60)
    found = packing.pack_pieces(frame(spark, rows).repartition(5), PATH, length=128).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    total = sum(len(ids[i]) for i, _ in rows)
    assert sum(r["length"] for r in found) == total
    places = sorted((r["sequence_id"] * 128 + r["offset"], r["length"]) for r in found)
    assert [p for p, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
    by_doc = {}
    for r in found:
        body = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(body) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] > 0 and r["offset"] + r["length"] <= 128
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for doc_id, parts in by_doc.items():
        times = 2 if doc_id == 3 else 1
        assert sum(n for _, n in parts) == times * len(ids[doc_id])


def test_sequences_hold_the_pieces_and_only_the_last_is_padded(spark, tokenizer):
    rows = texts(60)
    found = packing.pack_sequences(frame(spark, rows).repartition(4), PATH, length=128, pad=-9).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    found.sort(key=lambda r: r["sequence_id"])
    assert [r["sequence_id"] for r in found] == list(range(len(found)))
    assert all(r["n_tokens"] == 128 for r in found[:-1])
    stream, starts = [], []
    for r in found:
        starts += [(len(stream) + s, d) for s, d in zip(r["starts"], r["doc_ids"], strict=True)]
        stream += r["ids"][: r["n_tokens"]]
    assert len(stream) == sum(len(ids[i]) for i, _ in rows)
    begin, at = {}, 0
    for place, doc in starts:
        if place == at:
            begin[place] = doc
            at = place + len(ids[doc])
    for place, doc in begin.items():
        assert stream[place : place + len(ids[doc])] == ids[doc]
    last = found[-1]
    assert len(last["ids"]) == (last["n_tokens"] if last["n_tokens"].bit_count() == 1 else 128)
    assert set(last["ids"][last["n_tokens"] :]) <= {-9}


def test_a_short_sequence_with_a_power_of_two_tokens_is_not_padded(spark):
    one = packing.pack_sequences(frame(spark, [(1, None), (2, "")]), PATH, length=16).collect()
    assert [(r["n_tokens"], r["ids"], r["doc_ids"]) for r in one] == [(2, [1, 1], one[0]["doc_ids"])]
    assert sorted(one[0]["doc_ids"]) == [1, 2]
    three = packing.pack_sequences(frame(spark, [(1, ""), (2, ""), (3, "")]), PATH, length=16).collect()
    assert len(three[0]["ids"]) == 16


def test_no_rows(spark):
    assert packing.pack_pieces(frame(spark, []), PATH).count() == 0
    assert packing.pack_sequences(frame(spark, []), PATH).count() == 0
