"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database per worker.

A text is split by the tokenizer's pattern.  The distinct words that a batch
brings in become token-position rows in an in-memory DuckDB; a recursive query
joins neighbouring tokens to the merge table and contracts each word's leftmost
minimum-rank pair, round after round, until no pair of the word is in the
table.  A word that is itself in the vocabulary is its token, as in the tiktoken
library.  Words of more than ``LONG`` bytes go through a second recursive query
with the same result and fewer rounds: it contracts every disjoint occurrence of
the minimum-rank pair at once, up to the first one whose contraction would bring
forth a pair of lower rank (until there, leftmost-first takes just these).

Decoding is an ordered aggregation over (run, position) rows joined to the vocabulary; a
run holds a bounded number of a text's ids, and nothing is kept between the queries.

Null texts and null ids count as empty (0 tokens, empty bytes); repeated rows are
worked row by row; an empty table gives an empty table.  Texts are never cut.
Batches hold a bounded number of bytes and the words' ids are a bounded cache in two
generations: a word that is met again stays, the others go with their generation.
Output columns that clash with input columns replace them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import claim

LONG = 64
BATCH_BYTES = 2_000_000
WORDS_A_QUERY = 10_000
CACHE_WORDS = 400_000
#: Ids go to the decoding query in runs of so many, so many in all.
RUN_TOKENS, TOKENS_A_QUERY = 1_024, 200_000

#: ASCII members of the classes that patterns name.
ASCII_CLASSES = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "}

ENCODE = """
WITH RECURSIVE bpe(place, tok, live) AS (
    SELECT (w << 32) | i, tok, true FROM start
  UNION ALL
    (WITH best AS (
        SELECT a.place >> 32 AS w, min((p.rank << 32) | (a.place & 4294967295)) AS x
        FROM bpe a JOIN bpe b ON b.place = a.place + 1 JOIN pairs p ON p.pair = (a.tok << 16) | b.tok
        WHERE a.live AND b.live GROUP BY 1)
     SELECT s.place - coalesce((s.place & 4294967295) > (x & 4294967295), false)::BIGINT,
            CASE WHEN (s.place & 4294967295) = (x & 4294967295) THEN x >> 32 ELSE s.tok END, x IS NOT NULL
     FROM bpe s LEFT JOIN best ON best.w = s.place >> 32
     WHERE s.live AND (x IS NULL OR (s.place & 4294967295) <> (x & 4294967295) + 1))
)
SELECT place, tok FROM bpe WHERE NOT live
"""

ENCODE_LONG = """
WITH RECURSIVE bpe(w, i, tok, live) AS (
    SELECT w, i, tok, true FROM start
  UNION ALL
    (WITH paired AS (
        SELECT b.w, b.i, b.tok, lag(b.tok) OVER word AS before, p.rank, lead(b.tok, 2) OVER word AS after, row_number() OVER word AS k
        FROM (SELECT w, i, tok, lead(tok) OVER (PARTITION BY w ORDER BY i) AS nxt FROM bpe WHERE live) b
        LEFT JOIN pairs p ON p.pair = b.tok * 65536 + b.nxt
        WINDOW word AS (PARTITION BY b.w ORDER BY b.i)),
     least AS (SELECT *, min(rank) OVER (PARTITION BY w) AS best FROM paired),
     hits AS (
        SELECT w, k, x.pair IS NOT NULL OR y.pair IS NOT NULL OR z.pair IS NOT NULL AS stops,
               (k - first_value(k) OVER (PARTITION BY w, island ORDER BY k)) % 2 = 0 AS takes
        FROM (SELECT *, k - row_number() OVER (PARTITION BY w ORDER BY k) AS island FROM least WHERE rank = best) h
        LEFT JOIN sooner x ON x.pair = h.before * 65536 + h.rank
        LEFT JOIN sooner y ON y.pair = h.rank * 65536 + h.after
        LEFT JOIN sooner z ON z.pair = h.rank * 65536 + h.rank),
     taken AS (
        SELECT w, k FROM (
            SELECT w, k, coalesce(bool_or(stops) OVER (PARTITION BY w ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late
            FROM hits WHERE takes) WHERE NOT late)
     SELECT s.w, s.i, CASE WHEN t.k IS NULL THEN s.tok ELSE s.rank END, s.best IS NOT NULL
     FROM least s
     LEFT JOIN taken t ON t.w = s.w AND t.k = s.k
     LEFT JOIN taken g ON g.w = s.w AND g.k = s.k - 1
     WHERE g.k IS NULL)
)
SELECT (w << 32) | i AS place, tok FROM bpe WHERE NOT live
"""

DECODE = """
SELECT w, string_agg(v.bytes, '' ORDER BY i) AS bytes
FROM start JOIN vocabulary v ON v.id = start.tok GROUP BY w ORDER BY w
"""


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """What splits ASCII texts as the pattern does, for Python's quicker ``re``; None where the pattern has escapes or groups unknown here."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        for mark, chars in ASCII_CLASSES.items():
            if pattern.startswith(mark, at):
                out.append(chars if inside else f"[{chars}]")
                at += len(mark)
                break
        else:
            here = pattern[at]
            if not inside and pattern.startswith(r"\S", at):
                out.append(rf"[^{ASCII_CLASSES[chr(92) + 's']}]")
                at += 2
                continue
            if here == "\\" or not here.isascii() or (here == "(" and not inside and not pattern.startswith(("(?!", "(?="), at)) or (here == "[" and inside):
                return None
            inside = here == "[" or (inside and here != "]")
            out.append(here)
            at += 1
    return re.compile("".join(out))


class Remembered:
    """A bounded table of two generations; what is asked for again moves to the young one."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that are not known; all others are in ``young`` afterwards."""
        if len(self.young) + len(keys) > self.limit // 2:
            self.old, self.young = self.young, {}
        new = keys.difference(self.young)
        known = new & self.old.keys()
        self.young.update((k, self.old[k]) for k in known)
        return list(new - known)


class Codec:
    """Vocabulary tables in DuckDB and the bounded caches of one Python worker."""

    def __init__(self, rank_path: str, pattern: str):
        import duckdb
        import numpy as np
        import regex

        with open(rank_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = find = regex.compile(pattern).findall
        plain = ascii_pattern(pattern)
        self.find_ascii = plain.findall if plain else find
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.words = Remembered(CACHE_WORDS)
        tokens = {i: t for t, i in self.ranks.items()}
        rows = [
            (a * 65536 + b, i, i < max(a, b))
            for t, i in self.ranks.items()
            for c in range(1, len(t))
            if (a := self.ranks.get(t[:c])) is not None and (b := self.ranks.get(t[c:])) is not None
        ]
        pair, rank, sooner = (pa.array(x) for x in zip(*rows, strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("rows", pa.table({"pair": pair, "rank": rank, "sooner": sooner}))
        self.db.execute("CREATE TABLE pairs AS SELECT pair, rank::BIGINT AS rank FROM rows")
        #: Pairs that make a token of lower rank than one of their halves.
        self.db.execute("CREATE TABLE sooner AS SELECT pair FROM rows WHERE sooner")
        self.db.unregister("rows")
        # a byte travels as the character of that number: DuckDB aggregates strings
        self.db.register("rows", pa.table({"id": pa.array(tokens, pa.int64()), "bytes": [t.decode("latin-1") for t in tokens.values()]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM rows")
        self.db.unregister("rows")

    def _ask(self, sql: str, lengths: list[int], tokens) -> list:
        """The query's two columns over the token-position rows of sequences, given by their lengths and joined tokens."""
        import numpy as np

        lengths = np.array(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        rows = {
            "w": np.repeat(np.arange(len(lengths), dtype=np.int64), lengths),
            "i": np.arange(len(tokens), dtype=np.int64) - np.repeat(starts, lengths),
            "tok": tokens.astype(np.int64, copy=False),
        }
        self.db.register("start", pa.table(rows))
        out = list(self.db.execute(sql).fetchnumpy().values())
        self.db.unregister("start")
        return out

    def _learn(self, words: list[str]) -> None:
        import numpy as np

        young, rank_of = self.words.young, self.ranks.get
        rest = []
        for word in words:
            raw = word.encode()
            if (rank := rank_of(raw)) is not None:
                young[word] = rank.to_bytes(4, "little")
            else:
                rest.append((len(raw), word, raw))
        rest.sort(key=itemgetter(0))
        at = 0
        while at < len(rest):
            long, end, size = rest[at][0] > LONG, at, 0
            while end < len(rest) and (rest[end][0] > LONG) == long and end - at < WORDS_A_QUERY and (end == at or size < 1_000_000):
                size += rest[end][0]
                end += 1
            lengths, part, raws = zip(*rest[at:end], strict=True)
            place, tok = self._ask(ENCODE_LONG if long else ENCODE, lengths, self.single[np.frombuffer(b"".join(raws), np.uint8)])
            order = np.argsort(place)
            cuts = (4 * np.searchsorted(place[order] >> 32, np.arange(len(part) + 1))).tolist()
            ids = tok[order].astype("<u4").tobytes()
            young.update(zip(part, map(ids.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
            at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [(self.find_ascii if t.isascii() else self.find)(t) if t else [] for t in texts]
        self._learn(self.words.missing(set().union(*split)))
        get = self.words.young.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, coded: list[bytes | None]) -> list[bytes]:
        """The bytes that each sequence of ids stands for."""
        import numpy as np

        runs, owner = [], []
        for k, raw in enumerate(coded):
            ids = np.frombuffer(raw or b"", "<u4")
            cuts = range(0, len(ids), RUN_TOKENS)
            runs += [ids[c : c + RUN_TOKENS] for c in cuts]
            owner += [k] * len(cuts)
        out: list[list[bytes]] = [[] for _ in coded]
        at = 0
        while at < len(runs):
            end, size = at, 0
            while end < len(runs) and (end == at or size + len(runs[end]) <= TOKENS_A_QUERY):
                size += len(runs[end])
                end += 1
            part = runs[at:end]
            for w, text in zip(*(c.tolist() for c in self._ask(DECODE, [len(r) for r in part], np.concatenate(part))), strict=True):
                out[owner[at + w]].append(text.encode("latin-1"))
            at = end
        return [b"".join(parts) for parts in out]


@lru_cache(maxsize=2)
def codec(rank_path: str, pattern: str) -> Codec:
    return Codec(rank_path, pattern)


def _blocks(lengths: list[int]) -> Iterator[slice]:
    """Runs of rows of about BATCH_BYTES each."""
    at, size = 0, 0
    for k, n in enumerate(lengths):
        size += n
        if size >= BATCH_BYTES:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(lengths):
        yield slice(at, len(lengths))


def _mapped(df: DataFrame, source: str, added: dict[str, T.DataType], work) -> DataFrame:
    """df with the added columns that work(values) gives for the source column's values."""
    keep = [c for c in df.columns if c.lower() not in {a.lower() for a in added}]
    schema = T.StructType([f for f in df.schema if f.name in keep] + [T.StructField(c, t) for c, t in added.items()])
    arrow = {T.BinaryType(): pa.binary(), T.LongType(): pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", codec.cache_clear)
        do = work()
        for batch in batches:
            column = batch.column(batch.schema.names.index("__source"))
            for rows in _blocks(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                part = batch.slice(rows.start, rows.stop - rows.start)
                new = do(column.slice(rows.start, rows.stop - rows.start).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.names.index(c)) for c in keep] + [pa.array(v, arrow[t]) for v, t in zip(new, added.values(), strict=True)],
                    names=keep + list(added),
                )

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(source).alias("__source")).mapInArrow(run, schema)


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` of each text."""

    def work():
        own = codec(rank_path, pattern)

        def do(texts):
            ids = own.encode(texts)
            return ids, [len(x) // 4 for x in ids]

        return do

    return _mapped(df, text, {"ids": T.BinaryType(), "n_tokens": T.LongType()}, work)


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with ``decoded`` (binary): the bytes that the ids stand for."""
    return _mapped(df, ids, {"decoded": T.BinaryType()}, lambda: lambda coded: (codec(rank_path, pattern).decode(coded),))


def round_trip(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """encode(), then decode() of its ids, in one pass: ``ids``, ``n_tokens``, ``decoded``."""

    def work():
        own = codec(rank_path, pattern)

        def do(texts):
            ids = own.encode(texts)
            return ids, [len(x) // 4 for x in ids], own.decode(ids)

        return do

    return _mapped(df, text, {"ids": T.BinaryType(), "n_tokens": T.LongType(), "decoded": T.BinaryType()}, work)
