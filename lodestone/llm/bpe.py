"""Byte-level byte-pair encoding and decoding with a vocabulary of ranks, as recursive queries.

A vocabulary gives byte strings their ids, which are their ranks. The pattern cuts a
text into words, which are encoded each on its own: a word in the vocabulary is one
token; any other begins as its bytes, and of the neighbours whose joint bytes are in
the vocabulary the pair of least rank, the leftmost of equals, becomes one token,
until no such pair is left.

Each task runs DuckDB over its own rows. Words are rows of a position, its token and
the token that follows; a round of the recursive query joins them with the merge table
and contracts the least pair of every word. All equal pairs of a word are contracted in
one round where that can't change the result: what comes of a contraction must not make
a pair of lower rank (``alone`` marks those where it could; of these one goes at a time),
and of pairs that share a token the left one goes first (``clash``). Words that are done
drop out of the recursion. Distinct words are encoded once per task and remembered;
documents are put together from their words. Decoding joins tokens with the vocabulary
and aggregates their bytes in order.

Memory is bounded by the longest text and not by the table: words are taken in
slices of a text, positions go through a query in bounded numbers, and what is
remembered is forgotten beyond ``_REMEMBERED`` bytes.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fold, small_batches
from lodestone.llm.shingles import byte_slices
from lodestone.session import stored

_SLICE = 4_000_000  # bytes of text, or characters of one text, cut into words at once
_POSITIONS = 400_000  # positions that begin a recursive query
_STATES = 8 * _POSITIONS  # rows a recursive query may gather; those of a longer word take turns
_TOKENS = 100_000  # tokens decoded at once
_REMEMBERED = 48_000_000  # bytes of words and ids a task remembers
_MEMORY = "400MB"  # of a task's database

ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, n_tokens long, ids_le binary, decoded binary"

_CONTRACT = """
    with recursive state(round, word, pos, next, token, follower) as (
        select 0, word, pos, next, token, follower from start
        union all
        (with pair as (
            select s.word, s.pos, s.next as gone, m.id, m.alone, m.clash
            from state s join merges m on m.l = s.token and m.r = s.follower
            where s.round < $rounds),
        least as (select word, min(id) as id from pair group by word),
        equal as (select pair.* from pair join least using (word, id)),
        listed as (
            select *, row_number() over w as k, lag(gone) over w is distinct from pos as fresh
            from equal where alone or clash
            window w as (partition by word order by pos)),
        chain as (
            select *, k - max(case when fresh then k end) over (partition by word order by pos) as place
            from listed),
        picked as (
            select word, pos, gone, id from equal where not (alone or clash)
            union all
            select word, pos, gone, id from chain where case when alone then k = 1 else place % 2 = 0 end),
        taken as (
            select p.word, p.pos, p.gone, p.id, g.next, g.follower
            from picked p join state g on g.word = p.word and g.pos = p.gone)
        select s.round + 1, s.word, s.pos, coalesce(t.next, s.next), coalesce(t.id, s.token),
               coalesce(n.id, case when t.id is null then s.follower else t.follower end)
        from state s
        semi join least l on l.word = s.word
        left join taken t on t.word = s.word and t.pos = s.pos
        left join taken n on n.word = s.word and n.pos = coalesce(t.next, s.next)
        anti join taken g on g.word = s.word and g.gone = s.pos)
    )
    select round, word, pos, next, token, follower from state"""

_DECODE = """
    select text, string_agg(v.chars, '' order by t.pos) as chars, count(*) = count(v.id) as known
    from tokens t left join vocabulary v using (id) group by text order by text"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary in a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _connect():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": _MEMORY, "temp_directory": ""})


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """``l, r, id, alone, clash``: all pairs of tokens whose joint bytes are a token.

    ``alone``: the token ``id`` has a neighbour with which it makes a token of lower rank.
    ``clash``: two pairs that make ``id`` can share a token.
    """
    con = _connect()
    tokens = pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]})
    con.register("tokens", tokens)
    return con.sql("""
        with m as (
            select a.id as l, b.id as r, t.id
            from tokens t, unnest(range(2, length(t.hex), 2)) as c(cut)
            join tokens a on a.hex = substr(t.hex, 1, cut) join tokens b on b.hex = substr(t.hex, cut + 1)),
        lower as (select l as id from m where id < l union select r from m where id < r),
        twice as (select distinct a.id from m a join m b on b.l = a.r and b.id = a.id)
        select m.l, m.r, m.id, lower.id is not null as alone, twice.id is not null as clash
        from m left join lower on lower.id = m.id left join twice on twice.id = m.id
    """).to_arrow_table()


def text_slices(text: str, boundary, most: int):
    """A text in parts of about ``most`` characters, cut before white space that follows something else.

    No word of the pattern has white space after its other characters, and none looks
    behind, so the words of the parts are the words of the text.
    """
    start = 0
    while len(text) - start > most:
        cut = boundary.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Encoder:
    """Ids of texts; keeps the ids of words it has met."""

    def __init__(self, ranks: dict[bytes, int], merges: pa.Table, pattern: str):
        import regex

        self.ranks = ranks
        self.words = regex.compile(pattern)
        self.boundary = regex.compile(r"(?<=\S)\s")
        self.con = _connect()
        self.con.register("given", merges)
        self.con.execute("create table merges as select * from given")
        # Bytes without a rank can't be encoded: -1 is in no merge, and is refused at the end.
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self._forget()

    def _forget(self) -> None:
        """Known words by number, and where their ids begin in ``flat``."""
        self.number = defaultdict()
        self.number.default_factory = self.number.__len__
        self.begin, self.flat, self.size = np.zeros(1, np.int64), np.zeros(0, np.int32), 0

    def _learn(self) -> None:
        """The ids of the words numbered since the last call."""
        known = len(self.begin) - 1
        fresh = [w.encode() for w in islice(self.number, known, None)]
        found: list = [None] * len(fresh)
        waiting, positions = [], 0
        for k, word in enumerate(fresh):
            whole = self.ranks.get(word)
            if whole is not None:
                found[k] = np.array([whole], np.int32)
                continue
            waiting.append(k)
            positions += len(word)
            if positions >= _POSITIONS:
                self._contract(fresh, waiting, found)
                waiting, positions = [], 0
        if waiting:
            self._contract(fresh, waiting, found)
        if found:
            ends = self.begin[-1] + np.cumsum([len(f) for f in found])
            self.begin = np.concatenate([self.begin, ends])
            self.flat = np.concatenate([self.flat, *found])
            if self.flat.min() < 0:
                raise ValueError("the vocabulary lacks a byte that occurs in a text")
            self.size += sum(map(len, fresh)) * 10  # a word, its entry, and its ids

    def _contract(self, words: list[bytes], which: list[int], found: list) -> None:
        """Contract the words at ``which`` until nothing changes, and put their ids into ``found``."""
        n = np.array([len(words[k]) for k in which])
        flat = np.frombuffer(b"".join(words[k] for k in which), np.uint8)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        token = self.of_byte[flat]
        follower = np.append(token[1:], np.int32(-1))
        follower[np.cumsum(n) - 1] = -1
        state = pa.table(
            {
                "word": np.repeat(np.arange(len(which), dtype=np.int32), n),
                "pos": pos.astype(np.int32),
                "next": pos.astype(np.int32) + np.int32(1),
                "token": token,
                "follower": follower,
            }
        )
        while state.num_rows:
            rounds = max(1, _STATES // state.num_rows)
            self.con.register("start", state)
            every = self.con.sql(_CONTRACT, params={"rounds": rounds}).to_arrow_table()
            self.con.unregister("start")
            # A word's last round has its tokens; one that used all rounds goes on from there.
            of, number = every.column("round").to_numpy(), every.column("word").to_numpy()
            last = np.full(len(which), -1, np.int32)
            np.maximum.at(last, number, of)
            kept = of == last[number]
            state = every.filter(pa.array(kept & (of == rounds))).drop_columns(["round"])
            done = kept & (of < rounds)
            number, place, token = (every.column(c).to_numpy()[done] for c in ("word", "pos", "token"))
            order = np.lexsort((place, number))
            number, token = number[order], token[order]
            finished, first = np.unique(number, return_index=True)
            for k, a, b in zip(finished.tolist(), first, [*first[1:], len(number)], strict=False):
                found[which[k]] = token[a:b]

    def _ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words, one after the other, and the number of ids before each word and in all."""
        begin = self.begin[numbers]
        count = self.begin[numbers + 1] - begin
        upto = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(upto[-1]) - np.repeat(upto[:-1] - begin, count)
        return self.flat[at], upto

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the offsets between texts."""
        owners: list[int] = []  # the text of each part
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        held: list[np.ndarray] = []

        def flush():
            self._learn()
            flat, upto = self._ids(np.concatenate(held))
            ids.append(flat)
            counts.append(np.diff(upto[np.cumsum([0, *map(len, held)])]))
            held.clear()
            if self.size > _REMEMBERED:
                self._forget()

        chars = 0
        for k, text in enumerate(texts):
            for part in text_slices(text, self.boundary, _SLICE):
                words = self.words.findall(part)
                held.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
                owners.append(k)
                chars += len(part)
                if chars >= _SLICE:
                    flush()
                    chars = 0
        if held:
            flush()
        per_part = np.concatenate([np.zeros(0, np.int64), *counts])
        per_text = np.bincount(np.array(owners, np.int64), per_part, len(texts)).astype(np.int64)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(per_text)])


class Decoder:
    """The bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.con = _connect()
        # A byte is the character of its number, so that bytes can be aggregated as text.
        chars = [token.decode("latin-1") for token in ranks]
        self.con.register("given", pa.table({"id": pa.array(ranks.values(), pa.int32()), "chars": chars}))
        self.con.execute("create table vocabulary as select * from given")

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text; ``offsets`` are the places in ``ids`` between texts."""
        out = [bytearray() for _ in range(len(offsets) - 1)]
        for start in range(int(offsets[0]), int(offsets[-1]), _TOKENS):
            stop = min(start + _TOKENS, int(offsets[-1]))
            inside = np.diff(np.clip(offsets, start, stop))  # tokens of each text in this slice
            text = np.repeat(np.arange(len(inside), dtype=np.int32), inside)
            pos = np.arange(stop - start, dtype=np.int32)
            self.con.register("tokens", pa.table({"text": text, "pos": pos, "id": ids[start:stop]}))
            found = self.con.sql(_DECODE).to_arrow_table()
            self.con.unregister("tokens")
            if not all(found.column("known").to_pylist()):
                raise ValueError("an id is not in the vocabulary")
            for k, chars in zip(found.column("text").to_pylist(), found.column("chars").to_pylist(), strict=True):
                out[k] += chars.encode("latin-1")
        return [bytes(b) for b in out]

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of ``DECODED`` for rows of ``ENCODED``."""
        lists = batch.column(1)
        flat = lists.flatten()
        if flat.null_count:
            raise ValueError("an id is null")
        flat = flat.to_numpy(zero_copy_only=False).astype("<u4")
        sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        raw = flat.tobytes()
        le = [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        decoded = self.decode(flat.astype(np.int32), offsets)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(le, pa.binary()), pa.array(decoded, pa.binary())],
            [field.split()[0] for field in DECODED.split(", ")],
        )


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text, by the vocabulary in the file ``ranks``.

    Special tokens have no meaning: their names are ordinary text. A null text is an
    empty one and has no ids, as has an empty text; rows repeated, and rows with a null
    id, are encoded each; texts of any length are encoded whole; an empty table gives no
    rows. Other columns, whatever their names, are left out. The result is stored, so
    that what reads it doesn't encode again.
    """
    vocabulary = read_ranks(ranks)
    # Both follow the size of the vocabulary, not of the table.
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, merge_table(vocabulary)))

    def run(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(*shared.value, pattern)
            for rows in byte_slices(batch, 1, _SLICE):
                ids, offsets = encoder.encode(rows.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], ["doc_id", "ids"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(text).alias("text"))
    with small_batches(docs.sparkSession):
        return stored(slim.mapInArrow(run, ENCODED), "encoded")


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, n_tokens, ids_le, decoded``: lists of ids with the bytes they stand for.

    ``ids_le`` are the ids as little-endian unsigned 32-bit integers. A null list is an
    empty one and gives no bytes; an id outside the vocabulary, or a null one, raises.
    Rows repeated are decoded each; an empty table gives no rows; other columns are
    left out.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches):
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(shared.value)
            sizes = np.asarray(batch.column(1).value_lengths().fill_null(0))
            ends = np.cumsum(sizes)
            start = 0
            while start < batch.num_rows:
                # Rows with a few times as many tokens as are decoded at once.
                most = ends[start] - sizes[start] + 5 * _TOKENS
                stop = max(start + 1, int(np.searchsorted(ends, most, "right")))
                yield decoder.rows(batch.slice(start, stop - start))
                start = stop

    slim = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return slim.mapInArrow(run, DECODED)
