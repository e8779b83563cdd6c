"""Exact duplicates by content-defined chunk recipes.

A text is cut where its own characters say so, every chunk gets an identifier,
and a text becomes the ordered list of its chunks' identifiers. Identifiers are
verified before use: distinct chunks are gathered by content, and should two of
them share an identifier, all are drawn anew with another seed. From there on
only lists are compared and moved; no text is shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import attach_groups, fold, whole_row
from lodestone.session import stored

# A chunk ends where the low bits of the last nine characters' codes spell a fixed
# pattern, at about one place in 512, or at its greatest length. Characters beyond
# ASCII count as even.
LEAST, MOST = 64, 4000
_ODD = r"\x01\x03\x05\x07\t\x0B\r!#%')+/13579;=?ACEGIKMOQSUWY\[\]_acegikmoqsuwy{}"
_BITS = "".join(f"[{_ODD}]" if bit == "1" else f"[^{_ODD}]" for bit in "101100101")
_CUT = rf"(?s).{{{LEAST},{MOST}}}?(?:(?<={_BITS})|\z)|(?s).{{1,{MOST}}}"


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; put together they are the text."""
    return F.regexp_extract_all(text, F.lit(_CUT), F.lit(0))


def identifier(chunk: Column, seed: int) -> Column:
    """128 bits for a chunk, as an array of two longs."""
    return F.array(F.xxhash64(F.lit(2 * seed), chunk), F.xxhash64(F.lit(2 * seed + 1), chunk))


def shared_identifiers(docs: DataFrame, text: str, make, seed: int) -> int:
    """How many identifiers stand for more than one distinct chunk."""
    chunk = docs.select(F.explode(chunks(fold(text))).alias("c"))
    distinct = chunk.select(make(F.col("c"), seed).alias("i"), "c").distinct()
    return distinct.groupBy("i").count().filter("count > 1").count()


def recipes(docs: DataFrame, id_col: str, text: str, make=identifier, tries: int = 8) -> DataFrame:
    """``doc_id, text_sha256, recipe`` per row, with identifiers that are verified."""
    seed = next((s for s in range(tries) if not shared_identifiers(docs, text, make, s)), None)
    if seed is None:
        raise RuntimeError(f"chunks share identifiers with {tries} seeds")
    body = fold(text)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(body, 256).alias("text_sha256"),
        F.flatten(F.transform(chunks(body), lambda c: make(c, seed))).alias("recipe"),
    )


def find_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", make=identifier
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when every character is; null counts as the empty text. Of
    equal texts the row with the largest id stays. Of rows that repeat both id
    and text one stays. Rows without an id come after all others: one of them
    stays only if no row of the group has an id, and then ``keep_id`` is null.
    An empty table gives an empty table; other columns are ignored.
    """
    listed = stored(recipes(docs, id_col, text, make), "recipes")
    # Rows repeated whole are counted first, so that one of them can stay.
    rows = listed.groupBy("text_sha256", "recipe", "doc_id").agg(F.count("*").alias("n"))
    groups = stored(
        rows.groupBy("text_sha256", "recipe").agg(
            F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")
        ),
        "groups",
    )
    alone = F.expr("case when n > 1 then sequence(1, cast(n as int)) else array(1) end")
    found = attach_groups(rows, groups, ["text_sha256", "recipe"], "group_size")
    return found.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(alone).alias("i")).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("i") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row per distinct text.

    The rules are those of ``find_duplicates``. Of rows that repeat both id and
    text one stays, any of them when they differ in other columns.
    """

    def key(doc_id: Column, sha: Column) -> Column:
        return F.concat_ws(":", sha, doc_id.cast("string"))

    stay = find_duplicates(docs, id_col, text).filter("kept")
    keys = stay.select(key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    rows = docs.select(key(F.col(id_col), F.sha2(fold(text), 256)).alias("key"), whole_row(docs).alias("row"))
    return rows.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
