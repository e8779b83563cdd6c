"""Each stage of the pipeline against a plain version of it, on a small table."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import language, mixing
from lodestone.session import scratch_path
from tests.llm.test_language import SYLLABLES, sentence
from tests.llm.test_neardup import plain as components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make():
    draw = random.Random(11)
    rows = []
    for i in range(150):
        lang = draw.choice(list(SYLLABLES))
        text = sentence(draw, lang, draw.randint(20, 90))
        rows.append((i, text, lang, draw.choice(["a", "a", "a", "b", None]), len(text)))
    for i in range(150, 190):
        rows.append((i, *draw.choice(rows)[1:]))
    for i in range(190, 215):
        _, text, *rest = draw.choice(rows[:150])
        words = text.split()
        words[draw.randrange(len(words))] = "other"
        rows.append((i, " ".join(words), *rest))
    return rows + [(300, None, "en", "a", None), (301, "", "en", "b", 0), (302, "!! 12", None, "b", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    folder = scratch_path(spark, "pipeline-test")
    spark.createDataFrame(make(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_match_plain_versions(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{docs}/documents.parquet")
    rows = sorted(map(tuple, table.collect()))

    def apply(name, now):
        made = stages[name](spark, spark.createDataFrame(now, SCHEMA), docs)
        assert made.columns == table.columns or name == "pack"
        return sorted(map(tuple, made.collect())) if name != "pack" else made.collect()

    model = language.learn(spark.createDataFrame(rows, SCHEMA))
    wanted = [r for r in rows if not model.predict(r[1])[2]]
    rows = apply("language", rows)
    assert rows == wanted and {300, 301, 302}.isdisjoint(r[0] for r in rows)
    last = {r[1]: r for r in rows}
    rows = apply("exact_dedup", rows)
    assert rows == sorted(last.values())
    stay = {i for i, _, _, kept in components([r[:2] for r in rows], 80) if kept}
    before, rows = rows, apply("near_dedup", rows)
    assert rows == [r for r in before if r[0] in stay] and len(rows) < len(before)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sizes(spark.createDataFrame(rows, SCHEMA)).collect()}
    copies = Counter({r: taken[r[0]] // len(r[1].split()) for r in rows})
    rows = apply("mix", rows)
    assert Counter(rows) == +copies
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r[0]: len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows}
    packed = apply("pack", rows)
    assert sum(r["n_tokens"] for r in packed) == sum(sizes[r[0]] for r in rows)
    assert {d for r in packed for d in r["doc_ids"]} == {r[0] for r in rows}


def test_the_whole_run(spark, docs):
    packed = corpus_pipeline.run(spark, docs)
    assert packed.columns == ["sequence_id", "n_tokens", "ids", "doc_ids", "starts"]
    assert packed.count() > 0


def test_no_documents(spark):
    folder = scratch_path(spark, "pipeline-empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
