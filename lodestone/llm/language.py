"""Language identification by compression.

Each language has a raw-content dictionary of its own text. A text is compressed
with every dictionary in turn, in blocks so short that the dictionary and not the
text's own repetitions decides, and gets the language with the fewest bytes. A
text whose two best languages come out nearly alike is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import held_out, whole_row

UNKNOWN = "und"
SAMPLE_DOCS = 400  # learned documents per language, at most
SAMPLE_CHARS = 1_000  # characters of each of them that a dictionary takes
DICT_BYTES = 48_000
BLOCK = 1_000  # bytes of text compressed at a time
LEVEL = 6
SHORT, SHORT_LEVEL = 300, 12  # shorter blocks leave few bytes to compare and are compressed harder
MIN_MARGIN = 0.003  # a narrower margin, as a part of the best size, is a rejection


def _sample(docs: DataFrame, id_col: str, text: str, lang: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Up to about ``SAMPLE_DOCS`` texts per language, chosen by a hash of their ids, and the languages.

    A threshold on the hash, from the number of documents of the language, thins
    each language out where it lies, so the driver gets a bounded number of short
    texts. Languages are in the order of their numbers of documents.
    """
    rows = docs.filter(F.col(lang).isNotNull() & ~held_out(F.col(id_col)) & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(
        F.col(lang).cast("string").alias("lang"),
        F.substring(F.col(text), 1, SAMPLE_CHARS).alias("text"),
        F.pmod(F.xxhash64(id_col), F.lit(2**40)).alias("u"),
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    below = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(2**40 * SAMPLE_DOCS / n))])
    few = rows.filter(F.col("u") < below[F.col("lang")]) if counts else rows.limit(0)
    found = few.orderBy("lang", "u", "text").toLocalIterator()
    return [(r["lang"], r["text"]) for r in found], sorted(counts, key=lambda k: (-counts[k], k))


class Languages:
    """Dictionaries per language, the commonest language first; usable in any task."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL, block: int = BLOCK):
        self.content, self.level, self.block = content, level, block
        self._compressors = None

    def __getstate__(self):
        return {**self.__dict__, "_compressors": None}

    def _compressor(self, data: bytes, level: int, min_match: int):
        import zstandard

        how = zstandard.ZstdCompressionParameters.from_level(
            level, dict_size=len(data), min_match=min_match, write_content_size=False
        )
        shared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(compression_params=how, dict_data=shared)

    def sizes(self, text: str) -> np.ndarray:
        """Bytes of the whole text under each dictionary."""
        if self._compressors is None:
            usual = [self._compressor(d, self.level, 4) for d in self.content.values()]
            self._compressors = usual, [self._compressor(d, SHORT_LEVEL, 3) for d in self.content.values()]
        usual, hard = self._compressors
        raw = b" " + text.lower().encode("utf-8", "replace") + b" "
        total = np.zeros(len(self.content), np.int64)
        for start in range(0, len(raw), self.block):
            part = raw[start : start + self.block]
            total += [len(c.compress(part)) for c in (hard if len(part) < SHORT else usual)]
        return total

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the text is rejected.

        A text that is null or has no letter is ``und``, with score 0, and rejected.
        Ties go to the language with more learned documents. The score is the
        share of the best language if each bit per block of 64 bytes halved the odds.
        """
        if text is None or not self.content or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return next(iter(self.content)), 1.0, False
        behind = (sizes - sizes[best]) / max(1, sizes[best])
        odds = np.exp2(-behind * 64)
        second = np.sort(behind)[1]
        return list(self.content)[best], float(1 / odds.sum()), bool(second < MIN_MARGIN)


def _build(texts: list[tuple[str, str]], order: list[str]) -> dict[str, bytes]:
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in texts:
        by_lang.setdefault(lang, []).append(text.lower().encode("utf-8", "replace"))
    return {lang: b"\n".join(by_lang[lang])[-DICT_BYTES:] for lang in order if lang in by_lang}


def learn(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", cleaning_rounds: int = 2
) -> Languages:
    """Dictionaries from labelled documents that are not held out.

    The labelled sample is bounded by ``SAMPLE_DOCS`` and ``SAMPLE_CHARS`` per
    language. Labels may be wrong, so the sample is classified with what it gave,
    what disagrees with its label is left out, and dictionaries are built anew.
    """
    sample, order = _sample(docs, id_col, text, lang)
    model = Languages(_build(sample, order))
    for _ in range(cleaning_rounds):
        agreed = [(name, body) for name, body in sample if model.predict(body)[0] == name]
        labels = {name for name, _ in agreed}
        model = Languages(_build(agreed + [x for x in sample if x[0] not in labels], order))
    return model


def _classify(shared):
    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(2)]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)]
                + [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return run


def identify(
    docs: DataFrame, model: Languages | None = None, id_col: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    A text that is null or without a letter is ``und`` with score 0. Without any
    labelled document every text is. Rows repeated give the same answer each.
    """
    model = model or learn(docs, id_col, text, lang)
    slim = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text).alias("text")
    )
    kind = slim.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    # The model has at most DICT_BYTES per language.
    return slim.mapInArrow(_classify(docs.sparkSession.sparkContext.broadcast(model)), out)


def keep_identified(
    docs: DataFrame, model: Languages | None = None, id_col: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` whose language is clear, with all their columns and nothing else changed."""
    model = model or learn(docs, id_col, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clear(texts: pa.Array) -> pa.Array:
        return pa.array([not shared.value.predict(t.as_py())[2] for t in texts], pa.bool_())

    rows = docs.select(whole_row(docs).alias("row"), F.col(text).cast("string").alias("text"))
    return rows.filter(clear("text")).select("row.*")
