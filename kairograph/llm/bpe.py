"""Byte-level BPE encoding and decoding by recursive queries (operator 2).

Each Arrow batch is split into pre-tokens; the distinct ones that are no single
token become token-position rows ``(word, position, token)`` of a DuckDB
database inside the worker. A recursive query joins adjacent rows with the
merge table, contracts each word's leftmost pair of minimum rank, and goes on
until no word has a pair left. In words of ``LONG_WORD`` bytes and more a round
contracts that pair and every other whose turn cannot be changed by the rest of
the word, so the rounds do not grow with the word. Decoding joins the rows
``(document, position, token)`` of whole documents with the vocabulary and is an
ordered aggregation of the tokens' bytes. Both need no shuffle: a task works on
its own rows only, and what a task keeps of earlier batches (``KEEP`` words at
most) only saves time. Words are told apart by their bytes, not by a hash.

Defined cases: a null text is an empty text; an empty text has no token, the
digest of no bytes, and decodes to itself; repeated rows give repeated results;
an empty table gives an empty one; columns other than the id and the text are
not read. Texts and words are encoded whole whatever their length: a query holds
a bounded number of rounds or ids and starts from the state that the last one
left, so memory is in proportion to the longest text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import Classes, split
from .session import table
from .textbytes import pieces, release

#: Words that a task remembers from one batch to the next, and the longest of them in bytes.
KEEP, LONGEST = 180_000, 64
#: Bytes of texts, about, that are encoded at a time.
SLICE = 1 << 19
#: Words of one recursive query.
WORDS_A_QUERY = 16_000

#: Ids of one decoding query.
IDS_A_QUERY = 200_000
#: Rows of all rounds of one recursive query, about; what is not yet ended goes on in the next query.
ROWS_A_QUERY = 2_000_000
#: Bytes from which a word has a pair contracted wherever none near it has a smaller rank, not only its leftmost pair of minimum rank.
LONG_WORD = 256

#: ``state`` holds token-position rows with the token to the left (``beside``); positions stay dense. A contraction takes
#: the right one of its two rows out, so every other row knows by itself what becomes of it.
ENCODE_SQL = """
WITH RECURSIVE state(round, word, pos, token, beside) AS (
    SELECT 0, word, pos, token, beside FROM words
  UNION ALL (
    WITH least AS (
      SELECT s.word, min(m.token::BIGINT * 4294967296 + s.pos) AS packed
      FROM state s JOIN merges m ON m.pair = s.beside::BIGINT * 65536 + s.token WHERE s.round < {rounds} GROUP BY s.word
    ), best AS (
      SELECT word, (packed & 4294967295)::INTEGER AS pos, (packed >> 32)::INTEGER AS token FROM least
    )
    SELECT s.round + 1, s.word, s.pos - (s.pos > b.pos)::INTEGER,
      CASE WHEN s.pos = b.pos - 1 THEN b.token ELSE s.token END,
      CASE WHEN s.pos = b.pos + 1 THEN b.token ELSE s.beside END
    FROM state s JOIN best b ON b.word = s.word
    WHERE s.pos <> b.pos
  )
)
SELECT round, word, pos, token, beside FROM state
"""

#: The same for long words, many contractions a round; ``beside`` is the token to the right. ``pos`` is the token's first byte, and stays. No token is longer than
#: ``{reach}`` bytes over these words, so a contraction further away cannot touch a pair before its own turn: a pair goes
#: at once if none within reach has a smaller rank. Of equal ranks within reach the leftmost goes; where the token made
#: has no pair of a smaller rank (not ``alone``), all of them do, every other one in a run of overlapping pairs.
LONG_SQL = """
WITH RECURSIVE state(round, word, pos, token, beside) AS (
    SELECT 0, word, pos, token, beside FROM words
  UNION ALL (
    WITH pairs AS (
      SELECT s.word, s.pos, s.n, m.token, m.alone
      FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos) AS n FROM state WHERE round < {rounds}) s
      JOIN merges m ON m.pair = s.token::BIGINT * 65536 + s.beside
    ), near AS (
      SELECT *, n - row_number() OVER (PARTITION BY word, token ORDER BY n) AS island,
        min(token) OVER (PARTITION BY word ORDER BY pos RANGE BETWEEN {reach} PRECEDING AND 1 PRECEDING) AS before,
        min(token) OVER (PARTITION BY word ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 2 * {reach} FOLLOWING) AS behind
      FROM pairs
    ), least AS (
      SELECT *, coalesce(before >= token, true) AND coalesce(behind >= token, true) AS safe FROM near
    ), placed AS (
      SELECT word, pos, token, alone, safe AND coalesce(before > token, true) AS leftmost,
        bool_and(safe) OVER run AND row_number() OVER run % 2 = 1 AS odd
      FROM least WINDOW run AS (PARTITION BY word, token, island ORDER BY n)
    ), merged AS (
      SELECT word, pos, token FROM placed WHERE CASE WHEN alone THEN leftmost ELSE odd END
    ), kept AS (
      SELECT s.round, s.word, s.pos, coalesce(m.token, s.token) AS token, lag(m.pos) OVER (PARTITION BY s.word ORDER BY s.pos) AS gone
      FROM state s LEFT JOIN merged m ON m.word = s.word AND m.pos = s.pos WHERE s.word IN (SELECT word FROM merged)
    )
    SELECT round + 1, word, pos, token::INTEGER, coalesce(lead(token) OVER (PARTITION BY word ORDER BY pos), -1)::INTEGER
    FROM kept WHERE gone IS NULL
  )
)
SELECT round, word, pos, token, beside FROM state
"""

DECODE_SQL = """
SELECT e.word, list(v.bytes ORDER BY e.pos) AS parts
FROM encoded e JOIN vocabulary v ON v.token = e.token GROUP BY e.word
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """One worker's DuckDB database with the merge table, and its remembered words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import tiktoken

        self.ranks = ranks
        self.known: dict[bytes, tuple[str, int, bytes]] = {}
        # Nothing is spilled to a worker's own disk: a query that needs more memory than this fails its task.
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "autoinstall_known_extensions": "false"})
        self.db.execute("SET enable_progress_bar = false")
        #: The longest token that each byte occurs in.
        self.reach = np.zeros(256, np.int64)
        for token in ranks:
            own = np.frombuffer(token, np.uint8)
            self.reach[own] = np.maximum(self.reach[own], len(token))
        pairs, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left * 65536 + right)
                    merged.append(rank)
        made, smallest = np.array(merged, np.int64), np.full(65536, np.iinfo(np.int64).max)
        for side in (np.array(pairs, np.int64) >> 16, np.array(pairs, np.int64) & 65535):
            np.minimum.at(smallest, side, made)
        self._put("merges", pair=pa.array(pairs, pa.int64()), token=pa.array(merged, pa.int64()), alone=pa.array(smallest[made] < made))
        self._put("vocabulary", token=pa.array(list(ranks.values()), pa.int64()), bytes=pa.array(list(ranks), pa.binary()))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

        def joins(lead: str, characters: list[str]) -> list[bool]:
            probes = dict.fromkeys((lead + c).encode() for c in characters)
            own = {bytes([b]): b for b in range(256)} | {p: 256 + i for i, p in enumerate(probes)}
            probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=own, special_tokens={})
            return [len(probe.encode_ordinary(lead + c)) == 1 for c in characters]

        self.classes = Classes(joins)

    def _put(self, name: str, **columns: pa.Array) -> None:
        self.db.register("_incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM _incoming")
        self.db.unregister("_incoming")

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words one after another, and each word's number of ids."""
        ids = [self.ranks.get(w, -1) for w in words]
        parts = [(np.flatnonzero(whole := np.array(ids) >= 0), np.zeros(whole.sum(), np.int64), np.array(ids)[whole])]
        rest = np.flatnonzero(~whole)
        for part, query in self._portions(rest, np.array([len(words[i]) for i in rest], np.int64)):
            own = [words[i] for i in part]
            lengths = np.array([len(w) for w in own], np.int64)
            ends = np.cumsum(lengths)
            token = self.single[np.frombuffer(b"".join(own), np.uint8)]
            if query is LONG_SQL:
                beside = np.append(token[1:], -1)
                beside[ends - 1] = -1
            else:
                beside = np.append(-1, token[:-1])
                beside[ends - lengths] = -1
            state = {"word": np.repeat(np.arange(len(own)), lengths), "pos": np.arange(ends[-1]) - np.repeat(ends - lengths, lengths), "token": token, "beside": beside}
            reach = int(self.reach[np.frombuffer(b"".join(own), np.uint8)].max())
            while len(state["word"]):
                self._put("words", **{k: pa.array(v, pa.int32()) for k, v in state.items()})
                rounds = max(1, ROWS_A_QUERY // len(state["word"]))
                found = {k: c.to_numpy() for k, c in zip(("round", *state), self.db.sql(query.format(rounds=rounds, reach=reach)).to_arrow_table().columns, strict=True)}
                turn, word = found["round"], found["word"]
                last = np.zeros(len(own), turn.dtype)
                np.maximum.at(last, word, turn)
                final = turn == last[word]
                ended = final & (turn < rounds)
                parts.append((part[word[ended]], found["pos"][ended], found["token"][ended]))
                more = final & (turn == rounds)
                state = {k: found[k][more] for k in state}
        word, pos, token = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, word))
        return token[order].astype(np.int64), np.bincount(word, minlength=len(words))

    @staticmethod
    def _portions(rest: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, str]]:
        """Words of one recursive query each: at most ``WORDS_A_QUERY`` and, but for a longer word alone, a quarter of ``ROWS_A_QUERY`` bytes."""
        for query, own in ((ENCODE_SQL, lengths < LONG_WORD), (LONG_SQL, lengths >= LONG_WORD)):
            words, sizes, at = rest[own], np.cumsum(lengths[own]), 0
            while at < len(words):
                before = sizes[at - 1] if at else 0
                end = min(at + WORDS_A_QUERY, max(at + 1, int(np.searchsorted(sizes, before + ROWS_A_QUERY // 4, "right"))))
                yield words[at:end], query
                at = end

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids by the ordered aggregation, ``IDS_A_QUERY`` at a time; a run of none has no bytes."""
        run, pos = np.repeat(np.arange(len(counts)), counts), np.arange(len(ids))
        out = [b""] * len(counts)
        for a in range(0, len(ids), IDS_A_QUERY):
            part = slice(a, a + IDS_A_QUERY)
            self._put("encoded", word=pa.array(run[part]), pos=pa.array(pos[part]), token=pa.array(ids[part], pa.int64()))
            found = self.db.sql(DECODE_SQL).to_arrow_table().combine_chunks()
            lists = pa.concat_arrays(found["parts"].chunks)
            kind = lists.flatten().cast(pa.large_binary())
            data, at = kind.buffers()[2].to_pybytes(), np.frombuffer(kind.buffers()[1], np.int64)[kind.offset : kind.offset + len(kind) + 1]
            edges = at[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])].tolist()
            for i, word in enumerate(found["word"].to_pylist()):
                out[word] += data[edges[i] : edges[i + 1]]
        return out

    def learn(self, words: list[bytes]) -> dict[bytes, tuple[str, bytes]]:
        """Per word: its ids as text, and as the bytes of an array of longs."""
        ids, counts = self.words(words)
        names, raw = list(map(str, ids.tolist())), ids.tobytes()
        ends = np.cumsum(counts).tolist()
        starts = [0, *ends[:-1]] if ends else []
        return {word: (",".join(names[a:b]), raw[8 * a : 8 * b]) for word, a, b in zip(words, starts, ends, strict=True)}

    def batch(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Per text its words' ids as text; all texts' ids one after another; and each text's number of ids."""
        parts = split(texts, self.classes)
        at, back = parts.distinct(parts.hashes())
        words = parts.words(at)
        found = self.learn([w for w in words if w not in self.known])
        entries = [self.known[w] if w in self.known else found[w] for w in words]
        short = {w: x for w, x in found.items() if len(w) <= LONGEST}
        if len(self.known) + len(short) > KEEP:
            self.known.clear()
        if len(short) <= KEEP:
            self.known.update(short)
        sizes = np.array([len(x) // 8 for _, x in entries], np.int64)
        first = np.cumsum(sizes) - sizes
        each = sizes[back]
        sums = np.concatenate([[0], np.cumsum(each)])
        ids = np.frombuffer(b"".join([x for _, x in entries]), np.int64)[np.repeat(first[back] - sums[:-1], each) + np.arange(sums[-1])]
        names = np.array([x for x, _ in entries] + [None], object)[:-1][back].tolist()
        bounds = parts.first.tolist()
        return [names[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], ids, np.diff(sums[parts.first])


_codecs: dict[str, Codec] = {}


def codec(ranks, pattern: str) -> Codec:
    """The worker's codec for these broadcast ranks."""
    name = hashlib.sha256(repr(sorted(ranks.value.items())).encode() + pattern.encode()).hexdigest() if not hasattr(ranks, "_kg_name") else ranks._kg_name
    ranks._kg_name = name
    if name not in _codecs:
        _codecs[name] = Codec(ranks.value, pattern)
    return _codecs[name]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    for a, _, offsets in pieces(batch.column(1), limit=SLICE):
        b = a + len(offsets) - 1
        yield a, b, [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every text, in the order of the text."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def columns(own: Codec, texts: list[str]) -> list[pa.Array]:
        _, ids, counts = own.batch(texts)
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))]

    return _mapped(docs, ranks, pattern, id_col, text_col, "ids array<int>", columns)


def digests(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encoded, every document's ids decoded, and both digested where they are made."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def columns(own: Codec, texts: list[str]) -> list[pa.Array]:
        names, ids, counts = own.batch(texts)
        shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        return [pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in own.decoded(ids, counts)], pa.string())]

    return _mapped(docs, ranks, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _mapped(docs: DataFrame, ranks, pattern: str, id_col: str, text_col: str, columns: str, made) -> DataFrame:
    source = docs.select(F.col(id_col), F.col(text_col))
    kind = source.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    schema = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in spark.createDataFrame([], f"`{id_col}` {kind}, {columns}").schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for a, b, texts in _slices(batch):
                found = [x.cast(f.type) for x, f in zip(made(own, texts), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(schema.field(0).type), *found], schema=schema)
        own.known.clear()
        release()

    return source.mapInArrow(run, f"`{id_col}` {kind}, {columns}")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes)`` of rows of ids; a null or empty list decodes to no bytes."""
    ranks = tokens.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    source = tokens.select(F.col(id_col), F.col(ids_col).cast("array<bigint>").alias(ids_col))
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                lists = [x or [] for x in part.column(1).to_pylist()]
                flat = np.array([t for x in lists for t in x], np.int64)
                made = own.decoded(flat, np.array([len(x) for x in lists], np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=[id_col, "bytes"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
