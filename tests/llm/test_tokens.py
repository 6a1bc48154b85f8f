"""Splitting, encoding, decoding and counting against the public libraries."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kairograph.llm import bpe, pretokens, textbytes, tokencount

from .helpers import LONG, docs, odd_rows, thue_morse

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
HARD = ["it's  we'll 'tis ''s don't\n\n x", "  lead", "trail  ", "a" * 700, "naïve 日本語 ١٢٣ ½ ​ 　x\x1c\x85", "<|endoftext|> a<|endoftext|>  b", "\0", "🙂🙂 emoji", "'", " '", "\r\n\r\n"]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZ's tremvlld  \n\t 19é²Ⅷ一.!- 　\x85\x1c​\0"))), max_size=6))
def test_split_is_the_pattern(texts):
    parts = pretokens.split(texts, pretokens.Classes())
    raw = parts.data.tobytes()
    for i, t in enumerate(texts):
        got = [raw[parts.starts[k] : parts.ends[k]].decode() for k in range(parts.first[i], parts.first[i + 1])]
        assert got == regex.findall(P.PATTERN, t)


def rows():
    return odd_rows() + [(2000 + k, t, "en") for k, t in enumerate(HARD)]


def test_digests_are_those_of_the_library(spark, encoding):
    found = bpe.digests(docs(spark, rows()), RANKS, P.PATTERN).collect()
    texts = {i: t or "" for i, t, _ in rows()}
    assert len(found) == len(rows())
    for r in found:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_ids_decode_to_the_text(spark, encoding):
    tokens = bpe.encode(docs(spark, rows()), RANKS, P.PATTERN)
    assert {r.doc_id: r.ids for r in tokens.collect()}[103] == encoding.encode_ordinary(LONG)
    texts = {i: t or "" for i, t, _ in rows()}
    assert all(bytes(r.bytes).decode() == texts[r.doc_id] for r in bpe.decode(tokens, RANKS, P.PATTERN).collect())
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.bytes) for r in bpe.decode(odd, RANKS, P.PATTERN).collect()] == [b"", b""]


def test_counts_are_those_of_the_library(spark):
    tokenizer = Tokenizer.from_file(JSON)
    texts = {i: t or "" for i, t, _ in rows()}
    found = tokencount.token_counts(docs(spark, rows()), JSON).collect()
    assert len(found) == len(rows())
    for r in found:
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


def test_frequent_table_is_bounded_and_right(spark):
    text = open(JSON, encoding="utf-8").read()
    table = tokencount.frequent_table(text, docs(spark, rows()).select("text"))
    assert 10_000 < len(table) <= 50_257 + tokencount.SAMPLE_WORDS and table.counts.min() >= 1
    own = tokencount.Counter(text, tokencount.Frequent([], []))
    short = [t or "" for _, t, _ in rows() if len((t or "").encode()) <= tokencount.SAMPLE_BYTES and not any(x in (t or "") for x in own.special)]
    seen = pretokens.split([*short, LONG], own.classes)
    words = seen.words(np.arange(len(seen.starts)))
    counts = table.find(seen, np.arange(len(words)), seen.hashes())
    sampled = [w for w in words[: seen.first[-2]] if len(w) <= tokencount.LONGEST]
    known = {w for w, n in zip(words, counts, strict=True) if n > 0}
    assert {w for w in sampled if sampled.count(w) > 1} <= known and len(known) < len(set(words))
    assert counts[counts > 0].tolist() == own.encoded([w.decode() for w, n in zip(words, counts, strict=True) if n > 0])


def test_words_of_one_hash_are_kept_apart(spark, encoding, monkeypatch):
    """With all hashes equal, bytes alone decide; and real hashes part words that sums of powers do not."""
    pair = thue_morse(1024)
    data = np.frombuffer("".join(pair).encode(), np.uint8)
    assert len(set(textbytes.span_hashes(data, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 2
    texts = [pair[0], pair[1], "so " + pair[1] + " on", "one two one", "two 🙂 é", "x" * 300, "y" * 300, "x" * 300]
    for flat in (False, True):
        if flat:
            monkeypatch.setattr(pretokens.PreTokens, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
            monkeypatch.setattr(tokencount, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        own = bpe.Codec(bpe.load_ranks(RANKS), P.PATTERN)
        _, ids, counts = own.batch(texts)
        ends = counts.cumsum()
        assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)] == [encoding.encode_ordinary(t) for t in texts]
        assert own.decoded(ids, counts) == [t.encode() for t in texts]
        counter = tokencount.Counter(open(JSON, encoding="utf-8").read(), tokencount.Frequent([b"one", b" two", b" one"], [1, 1, 1]))
        assert counter.counts(texts).tolist() == [len(counter.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_empty_tables(spark):
    assert bpe.digests(docs(spark, []), RANKS, P.PATTERN).count() == 0
    assert tokencount.token_counts(docs(spark, []), JSON).count() == 0


def test_long_words_are_encoded_in_bounded_memory(encoding, monkeypatch):
    import random

    letters = random.Random(5)
    own = bpe.Codec(bpe.load_ranks(RANKS), P.PATTERN)
    largest, db = [], own.db

    class Counting:
        def __getattr__(self, name):
            return getattr(db, name)

        def sql(self, query):
            found = db.sql(query).to_arrow_table()
            largest.append(len(found))
            return type("Found", (), {"to_arrow_table": lambda _: found})()

    monkeypatch.setattr(own, "db", Counting())
    words = ["-" * 100_000, "日本語文字" * 300, "a" * 257, "ab" * 140, "".join(letters.choices("etaoinshr", k=4000)), "".join(letters.choices("théré", k=300)), *("".join(letters.choices("abcdehlnrst", k=n)) for n in range(2, 300, 3))]
    ids, counts = own.words([w.encode() for w in words])
    ends = counts.cumsum()
    for word, a, b in zip(words, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == encoding.encode_ordinary(word)
    assert max(largest) <= 2 * bpe.ROWS_A_QUERY


def test_one_word_may_be_a_whole_text(encoding):
    """50,000 letters and 50,000 ideographs without a break, in a process of its own: equal to the library, and under 500 MB."""
    import subprocess
    import sys

    code = f"""
import random, resource, sys
from kairograph.llm import bpe, tokencount
import public_tokenizers as P, tiktoken
ranks, r = bpe.load_ranks({RANKS!r}), random.Random(2)
words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=50_000)), "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(50_000))]
if sys.argv[1] == "bpe":
    own = bpe.Codec(ranks, P.PATTERN)
    _, ids, counts = own.batch(words)
    assert own.decoded(ids, counts) == [w.encode() for w in words]
    assert counts[0] > 10_000 and ids.tolist() == [i for w in words for i in tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={{}}).encode_ordinary(w)]
else:
    text = open({JSON!r}, encoding="utf-8").read()
    own = tokencount.Counter(text, tokencount.Frequent([], []))
    assert own.counts(words).tolist() == [len(own.tokenizer.encode(w, add_special_tokens=False).ids) for w in words]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    for what in ("bpe", "count"):
        done = subprocess.run([sys.executable, "-c", code, what], capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr
        assert int(done.stdout) < 500
