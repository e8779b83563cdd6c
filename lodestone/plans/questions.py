"""Answering a table of questions up to the prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import retrieval
from lodestone.operators.embedding import BATCH
from lodestone.session import stored


def answer_inputs(
    questions: DataFrame,
    vectors: DataFrame,
    embedder,
    namespace: str,
    k: int = retrieval.TOP_K,
    batch: int = BATCH,
) -> DataFrame:
    """One row per question (query_id, text): its prompt and sources, or the error of its embedding."""
    embedded = retrieval.embed_questions(questions.select("query_id", "text"), embedder, batch)
    hits = stored(retrieval.best_chunks(embedded, vectors, namespace, k), "hits")
    prompts = retrieval.assemble_prompts(hits, questions)
    answers = prompts.join(retrieval.sources(hits), "query_id", "left")
    answers = answers.join(embedded.select("query_id", "error"), "query_id", "left")
    return answers.withColumn("prompt", F.when(F.col("error").isNull(), F.col("prompt")))
