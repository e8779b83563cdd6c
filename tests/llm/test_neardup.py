import random
import re

import pytest

from lodestone.llm import neardup

SCHEMA = "doc_id long, text string, rep string, bands string, d1 int"
LOWER = {chr(i): chr(i + 32) for i in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(LOWER)))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(rows, percent=85):
    """All pairs, and components by merging."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def edited(draw, words, changes):
    out = list(words)
    for _ in range(changes):
        out[draw.randrange(len(out))] = f"new{draw.randrange(10**6)}"
    return out


def corpus(seed):
    """Copies, near copies of near copies, a large group around the threshold, and unrelated texts."""
    draw = random.Random(seed)
    texts = []
    for g in range(12):
        base = [f"w{draw.randrange(300)}" for _ in range(draw.choice([6, 40, 200, 1500]))]
        for _ in range(draw.randint(1, 6)):
            base = edited(draw, base, draw.choice([0, 1, 2, 3]))
            texts.append(" ".join(base) if g % 2 else "  ".join(base).upper())
    base = [f"v{draw.randrange(500)}" for _ in range(150)]
    texts += [" ".join(edited(draw, base, draw.randint(0, 4))) for _ in range(220)]
    texts += [" ".join(f"u{draw.randrange(50)}" for _ in range(draw.randint(1, 30))) for _ in range(60)]
    texts += ["", None, "one", "one", "ONE", "two words", " two\twords ", "a b c d e", "a b c d e f", "é É"]
    draw.shuffle(texts)
    return [(10 * i + 3, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "?", "?", 1) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    rows = corpus(seed)
    found = neardup.near_duplicates(frame(spark, rows).repartition(4)).collect()
    assert sorted(map(tuple, found)) == plain(rows)


def test_sketches_estimate_and_never_exceed_two_bits_per_sample():
    import numpy as np

    draw = np.random.default_rng(3)
    a = draw.integers(0, 2**63, (50, neardup.SAMPLES), np.uint64)
    b = a.copy()
    b[:, :12] += np.uint64(1)
    bits = np.bitwise_count((neardup.sketches(a) ^ neardup.sketches(b)).view(np.uint64)).sum(axis=1)
    assert bits.max() <= 24 and 15 < bits.mean() < 24


def test_sketches_lose_fewer_pairs_at_the_threshold_than_bands():
    import numpy as np

    for percent in (50, 80, 85, 86, 90, 99, 100):
        share = percent / 100
        most = neardup._estimate_allows(share)
        missed = neardup.sketch_miss(share)
        assert missed[most] <= min(neardup.band_miss(share), 1e-6)
        assert most == 0 or missed[most - 1] > min(neardup.band_miss(share), 1e-6)
    # The distribution is the one that sketches have.
    draw = np.random.default_rng(6)
    a = draw.integers(0, 2**63, (40_000, neardup.SAMPLES), np.uint64)
    b = np.where(draw.random(a.shape) < 0.85, a, draw.integers(0, 2**63, a.shape, np.uint64))
    bits = np.bitwise_count((neardup.sketches(a) ^ neardup.sketches(b)).view(np.uint64)).sum(axis=1)
    for most in (20, 30, 40, 46):
        chance = neardup.sketch_miss(0.85)[most]
        assert abs((bits > most).mean() - chance) < 5 * (chance * (1 - chance) / len(bits)) ** 0.5


def test_one_document_of_each_group_stays_with_all_columns(spark):
    rows = corpus(4)
    kept = neardup.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "rep", "bands", "d1"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, _, stays in plain(rows) if stays]


def test_missing_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, text), (5, text), (5, text), (9, text), (5, "quite other words are in this one")]
    found = sorted((tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert found == sorted(
        [(None, 26, None, True)] * 2 + [(5, 26, 5, True)] * 2 + [(9, 26, 5, False), (5, 3, 5, True)], key=str
    )


def test_a_row_repeated_gives_one_set():
    import pyarrow as pa

    texts = ["a b c d e f", "other words"] * 50
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([7] * 100 + [8], pa.int64()), "text": [*texts, texts[0]]})
    rows = [r for b in neardup._build_sets([batch, batch.slice(100)]) for r in b.to_pylist()]
    assert [(r["doc_id"], len(r["hashes"])) for r in rows] == [(7, 2), (7, 1), (8, 2)]


def test_jobs_get_one_set_of_an_id_repeated(spark, monkeypatch):
    draw = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base))] * 40 + [(2, " ".join(edited(draw, base, 1)))] * 40
    most = spark.sparkContext.accumulator(0)
    confirm = neardup._confirm

    def counted(pairs, sets, percent):
        most.add(len(sets))
        return confirm(pairs, sets, percent)

    monkeypatch.setattr(neardup, "_confirm", counted)
    found = neardup.near_duplicates(frame(spark, rows).repartition(4)).collect()
    assert sorted(map(tuple, found)) == [(1, 196, 1, True)] * 40 + [(2, 196, 1, False)] * 40
    assert most.value == 2


def test_no_rows_and_no_words(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    found = neardup.near_duplicates(frame(spark, [(1, ""), (2, None), (3, " \n")])).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
