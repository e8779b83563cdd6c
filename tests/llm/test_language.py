import random
import zlib

import zstandard

from lodestone.llm import language

SCHEMA = "doc_id long, text string, lang string, held_out string, rejected int"
SYLLABLES = {
    "en": "the and ing tion er th wh ou ea st nd of that".split(),
    "de": "sch der und ein ung keit ich ver ge zu über lich".split(),
    "es": "que ción el los ado ez ñ as de rr ll mente".split(),
}


def sentence(draw, lang, words):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 3))) for _ in range(words))


def make(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        lang = draw.choice(["en", "en", "de", "es"])
        label = draw.choice(list(SYLLABLES)) if i % 40 == 7 else lang
        rows.append((i, sentence(draw, lang, draw.randint(8, 120)), label, lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, label, "?", 0) for i, t, label in rows], SCHEMA)


def test_held_out_accuracy_and_columns(spark):
    rows = make(400)
    found = {r["doc_id"]: r for r in language.identify(frame(spark, [r[:3] for r in rows])).collect()}
    assert len(found) == 400
    tried = [(found[i], lang) for i, _, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r["held_out"] for r, _ in tried) and sum(r["held_out"] for r in found.values()) == len(tried)
    assert sum(r["lang_pred"] == lang for r, lang in tried) >= 0.97 * len(tried)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_the_label_of_a_held_out_row_changes_nothing(spark):
    rows = [r[:3] for r in make(120)]
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else label) for i, t, label in rows]
    a, b = (sorted(map(tuple, language.identify(frame(spark, r)).collect())) for r in (rows, other))
    assert a == b


def test_texts_without_letters_are_unknown_and_long_ones_are_read_whole(spark):
    draw = random.Random(5)
    model = language.learn(frame(spark, [r[:3] for r in make(300)]))
    turned = sentence(draw, "en", 50) + " " + sentence(draw, "es", 20_000)
    rows = [(1, None, None), (2, "", None), (3, "12 %% 4", None), (4, turned, "en"), (4, turned, "en"), (None, "und die der", None)]
    found = language.identify(frame(spark, rows), model).collect()
    got = sorted(((r["doc_id"] or 0, r["lang_pred"]) for r in found))
    assert got[1:] == [(1, "und"), (2, "und"), (3, "und"), (4, "es"), (4, "es")]
    assert all(r["score"] == 0 and r["rejected"] for r in found if r["lang_pred"] == "und")


def test_a_text_of_two_languages_in_equal_parts_is_rejected_and_goes(spark):
    draw = random.Random(6)
    model = language.learn(frame(spark, [r[:3] for r in make(300)]))
    clear = [(i, sentence(draw, lang, 60), lang) for i, lang in enumerate(["en", "de", "es"])]
    narrow = language.Languages(model.content)
    assert [narrow.predict(t)[2] for _, t, _ in clear] == [False] * 3
    kept = language.keep_identified(frame(spark, [*clear, (7, "...", None), (8, None, None)]), model)
    assert kept.columns == ["doc_id", "text", "lang", "held_out", "rejected"]
    assert sorted(map(tuple, kept.collect())) == [(i, t, lang, "?", 0) for i, t, lang in clear]
    same = language.Languages({"a": b"same words here", "b": b"same words here"})
    assert same.predict("same words here")[2]


def test_without_labels_or_rows(spark):
    found = language.identify(frame(spark, [(1, "some words", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in found] == [("und", 0.0)]
    assert language.identify(frame(spark, [])).count() == 0
    assert language.keep_identified(frame(spark, [])).count() == 0


def plain(content, text):
    """Language, score and rejection by a plain loop that compresses every block anew."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    raw, sizes = (" " + text.lower() + " ").encode(), {}
    for lang, data in content.items():
        sizes[lang] = 0
        for start in range(0, len(raw), 1000):
            block = raw[start : start + 1000]
            level, least = (12, 3) if len(block) < 300 else (6, 4)
            how = zstandard.ZstdCompressionParameters.from_level(
                level, dict_size=len(data), min_match=least, write_content_size=False
            )
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=how)
            sizes[lang] += len(zstandard.ZstdCompressor(compression_params=how, dict_data=own).compress(block))
    best = min(sizes, key=sizes.get)
    behind = {k: (n - sizes[best]) / sizes[best] for k, n in sizes.items()}
    score = 1 / sum(2 ** (-64 * b) for b in behind.values())
    return best, score, min(b for k, b in behind.items() if k != best) < 0.003


def test_predictions_match_a_plain_loop(spark):
    rows = [(i, t, label) for i, t, label, _ in make(150, seed=5)]
    model = language.learn(frame(spark, rows))
    draw = random.Random(6)
    mixed = sentence(draw, "en", 60) + " " + sentence(draw, "de", 60)
    odd = [None, "", "12 34", "é", mixed, sentence(draw, "es", 4000), "the " * 3000]
    rows += [(1000 + i, t, None) for i, t in enumerate(odd)]
    found = {r["doc_id"]: r for r in language.identify(frame(spark, rows), model).collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        lang, score, rejected = plain(model.content, text)
        assert (found[i]["lang_pred"], found[i]["rejected"]) == (lang, rejected)
        assert abs(found[i]["score"] - score) < 1e-9
