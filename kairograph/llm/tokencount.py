"""Token counts by a map-side two-tier lookup (operator 3).

Tier one is a compact broadcast hash table of frequent pre-tokens with their
token counts: the tokenizer's own vocabulary (what a BPE vocabulary holds is what
was frequent), and the pre-tokens that turn up most in a bounded sample of the
input (``SAMPLE_ROWS`` short texts, ``SAMPLE_WORDS`` words; the sample decides how fast a
count is found, never what it is). Tier two is a bounded cache in each worker: a
pre-token that misses the table is encoded by the library once and remembered. No
pre-token is ever shuffled. Hashes only lead to a place; bytes are compared there.

Defined cases: a null text is an empty text with no token; texts that contain
one of the tokenizer's special strings go to the library whole, because the
library cuts them there first; texts and pre-tokens of any length are counted
whole, in memory in proportion to the longest text, and pre-tokens of more than
``LONGEST`` bytes are not remembered; repeated rows give repeated results; an
empty table gives an empty one; columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import Classes, PreTokens, split
from .session import table
from .textbytes import pieces, release, same_spans, span_hashes

#: Pre-tokens that a worker remembers, the longest of them, and how many the library encodes at a time.
KEEP, LONGEST, AT_ONCE = 150_000, 64, 4_000
#: Texts of the sample, the longest of them in bytes (all are sent to the driver), and the pre-tokens taken from it.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_WORDS = 1_000, 16_384, 20_000
LIMIT = 512


class Frequent:
    """Tier one: an open hash table over the words' bytes, as arrays."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.ends = np.cumsum(np.array([len(w) for w in words], np.int64))
        self.starts = self.ends - np.array([len(w) for w in words], np.int64)
        self.counts = np.array(counts, np.int32)
        self.bits = max(4, math.ceil(math.log2(max(1, len(words)) * 2)))
        self.hashes = span_hashes(self.blob, self.starts, self.ends)
        slot = self._slot(self.hashes)
        order = np.argsort(slot, kind="stable")
        step = np.arange(len(words))
        place = np.maximum.accumulate(slot[order] - step) + step if len(words) else slot
        #: The entry at each slot; -1 is an empty one, and one always follows the last entry.
        self.slots = np.full(max(1 << self.bits, int(place[-1]) + 1 if len(words) else 0) + 1, -1, np.int32)
        self.slots[place] = order

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).view(np.int64)

    def __len__(self) -> int:
        return len(self.counts)

    def find(self, parts: PreTokens, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The count of each of some pre-tokens, -1 where the table has not its bytes."""
        out = np.full(len(at), -1, np.int64)
        slot, rest = self._slot(hashes), np.arange(len(at))
        while len(rest):
            entry = self.slots[slot[rest]]
            rest, entry = rest[entry >= 0], entry[entry >= 0]
            near = self.hashes[entry] == hashes[rest]
            hit, entry = rest[near], entry[near]
            same = same_spans(parts.data, parts.starts[at[hit]], parts.ends[at[hit]], self.blob, self.starts[entry], self.ends[entry])
            out[hit[same]] = self.counts[entry[same]]
            rest = rest[out[rest] < 0]
            slot[rest] += 1
        return out


class Counter:
    """One worker's tokenizer, tier-one table and cache."""

    def __init__(self, json_text: str, frequent: Frequent):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.frequent = frequent
        self.cache: dict[bytes, int] = {}
        pre = self.tokenizer.pre_tokenizer

        def joins(lead: str, characters: list[str]) -> list[bool]:
            return [len(pre.pre_tokenize_str(lead + c)) == 1 for c in characters]

        self.classes = Classes(joins)

    def encoded(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for a in range(0, len(texts), AT_ONCE):
            out += [len(x) for x in self.tokenizer.encode_batch_fast(texts[a : a + AT_ONCE], add_special_tokens=False)]
        return out

    def _missed(self, words: list[bytes]) -> list[int]:
        """Counts of words that the table has not: remembered, or encoded now."""
        new = [w for w in words if w not in self.cache]
        found = dict(zip(new, self.encoded([w.decode() for w in new]), strict=True))
        out = [self.cache[w] if w in self.cache else found[w] for w in words]
        short = {w: n for w, n in found.items() if len(w) <= LONGEST}
        if len(self.cache) + len(short) > KEEP:
            self.cache.clear()
        if len(short) <= KEEP:
            self.cache.update(short)
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if whole:
            out[whole] = self.encoded([texts[i] for i in whole])
            texts = list(texts)
            for i in whole:
                texts[i] = ""
        parts = split(texts, self.classes)
        hashes = parts.hashes()
        if not len(hashes):
            return out
        at, back = parts.distinct(hashes)
        lengths = self.frequent.find(parts, at, hashes[at])
        missed = np.flatnonzero(lengths < 0)
        lengths[missed] = self._missed(parts.words(at[missed]))
        sums = np.concatenate([[0], np.cumsum(lengths[back])])
        return out + sums[parts.first[1:]] - sums[parts.first[:-1]]


def vocabulary_words(counter: Counter) -> list[str]:
    """The vocabulary's entries that are one pre-token."""
    tokenizer = counter.tokenizer
    words = [tokenizer.decode([i]) for i in range(tokenizer.get_vocab_size(with_added_tokens=False))]
    words = [w for w in words if w and "�" not in w and not any(s in w for s in counter.special)]
    one = np.diff(split(words, counter.classes).first) == 1
    return [w for w, k in zip(words, one.tolist(), strict=True) if k]


def sample_words(texts: DataFrame, counter: Counter, rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS) -> list[str]:
    """The pre-tokens seen most, and more than once, in ``rows`` texts of at most ``SAMPLE_BYTES``, the first that the scan meets."""
    column = texts.columns[0]
    found = [r[0] for r in texts.where(F.octet_length(F.col(column)) <= SAMPLE_BYTES).limit(rows).collect()]
    found = [t for t in found if not any(s in t for s in counter.special)]
    parts = split(found, counter.classes)
    if not len(parts.starts):
        return []
    at, back = parts.distinct(parts.hashes())
    times = np.bincount(back)
    some = np.flatnonzero((parts.ends[at] - parts.starts[at] <= LONGEST) & (times > 1))
    some = some[np.argsort(-times[some], kind="stable")][:words]
    return [w.decode() for w in parts.words(at[some])]


def frequent_table(json_text: str, texts: DataFrame | None = None) -> Frequent:
    """Tier one of a tokenizer for these ``texts(text)``, bounded by the vocabulary and ``SAMPLE_WORDS``."""
    counter = Counter(json_text, Frequent([], []))
    words = list(dict.fromkeys([*vocabulary_words(counter), *(sample_words(texts, counter) if texts is not None else [])]))
    return Frequent([w.encode() for w in words], counter.encoded(words))


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every text."""
    with open(tokenizer_path, encoding="utf-8") as file:
        json_text = file.read()
    source = docs.select(F.col(id_col), F.col(text_col))
    shared = docs.sparkSession.sparkContext.broadcast((json_text, frequent_table(json_text, docs.select(F.col(text_col)))))
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, frequent = shared.value
        if text not in _counters:
            _counters.clear()
            _counters[text] = Counter(text, frequent)
        own = _counters[text]
        own.frequent = frequent
        for batch in batches:
            for a, _, offsets in pieces(batch.column(1)):
                rows = len(offsets) - 1
                n = own.counts([t or "" for t in batch.column(1).slice(a, rows).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, rows), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])
        own.cache.clear()
        release()

    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
