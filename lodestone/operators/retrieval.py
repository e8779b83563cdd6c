"""From questions to prompts and source lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.embedding import BATCH, with_vectors
from lodestone.operators.search import TOP_K, search
from lodestone.session import stored

TEMPLATE = """Answer the question from the context below. If the context does not contain the \
answer, say that it could not be found.

Context:
{context}

Question: {question}

Answer:"""


def embed_questions(questions: DataFrame, embedder, batch: int = BATCH) -> DataFrame:
    """Questions with ``values``, or with the ``error`` of their batch; stored, so each is embedded once."""
    return stored(with_vectors(questions, embedder, batch), "questions")


def ask(questions: DataFrame, vectors: DataFrame, embedder, namespace: str, k: int = TOP_K) -> DataFrame:
    """The best chunks of ``namespace`` for a table of (query_id, text) questions.

    A question that could not be embedded has none; ``embed_questions`` tells why.
    """
    return best_chunks(embed_questions(questions, embedder), vectors, namespace, k)


def best_chunks(embedded: DataFrame, vectors: DataFrame, namespace: str, k: int = TOP_K) -> DataFrame:
    """The best chunks of ``namespace`` for embedded questions."""
    embedded = embedded.filter("error is null")
    corpus = vectors.filter(F.col("namespace") == namespace).select(
        "id", "values", "metadata.source", "metadata.text"
    )
    return search(embedded.select("query_id", "values"), corpus, k)


def assemble_prompts(hits: DataFrame, questions: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One prompt per question, its hits' texts in rank order; at most k per question."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    texts = F.array_join(F.transform(ordered, lambda h: h["text"]), "\n\n")
    contexts = hits.groupBy("query_id").agg(texts.alias("_context"))
    before, after = template.split("{context}")
    fill = [F.replace(F.lit(part), F.lit("{question}"), F.col("text")) for part in (before, after)]
    prompt = F.concat(fill[0], F.coalesce("_context", F.lit("")), fill[1])
    asked = questions.select("query_id", "text").join(contexts, "query_id", "left")
    return asked.select("query_id", F.col("text").alias("question"), prompt.alias("prompt"))


def sources(hits: DataFrame) -> DataFrame:
    """Sources per question in rank order; a source hit twice is listed twice."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "source")))
    listed = F.transform(ordered, lambda h: h["source"])
    return hits.groupBy("query_id").agg(listed.alias("sources"))
