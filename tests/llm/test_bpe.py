import hashlib
import random
import time

import public_tokenizers
import tiktoken
from helpers import empty_docs, odd_docs
from hypothesis import given, settings, strategies as st

from resultloom.llm import bpe, queries
from resultloom.llm.common import table

PATH = public_tokenizers.path(queries.RANKS)
RANKS = bpe.read_ranks(PATH)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = bpe.Coder(RANKS)
PARTS = ["a", "b", " ", "  ", "\n", "'s", "'ll", "'", "é", "1", "²", " ", "\t", "don't", "!!", "ſ", "漢字", "́", "x" * 50, "ab" * 40, "\r\n", "'re", "_", "😀", " ", "\x1c", "\x85", "'l", "\x00"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=20).map("".join), max_size=6), st.text(max_size=60))
def test_blocks_equal_the_library(texts, other):
    texts = [*texts, other.encode("utf-8", "ignore").decode()]
    ids, bound = CODER.encode([t.encode() for t in texts])
    got = [ids[a:b].tolist() for a, b in zip(bound, bound[1:])]
    assert got == [PLAIN.encode_ordinary(t) for t in texts]
    assert [CODER.decode(g) for g in got] == [t.encode() for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_join_is_the_monoid_operation(a, b):
    assert CODER.join(CODER.merged(a), CODER.merged(b)) == CODER.merged(a + b)
    assert CODER.tree(a + b) == CODER.merged(a + b)


def test_long_pieces_and_periods():
    rng = random.Random(3)
    for letters in ("ab", "aeth", "a", "the", "xyz!"):
        piece = "".join(rng.choice(letters) for _ in range(3000))
        ids, _ = CODER.encode([piece.encode()])
        assert ids.tolist() == PLAIN.encode_ordinary(piece)


def test_odd_rows(spark):
    df = bpe.decode(bpe.encode(odd_docs(spark), PATH), PATH)
    for r in df.collect():
        assert list(r["ids"]) == PLAIN.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert set(df.columns) == {*odd_docs(spark).columns, "decoded"}
    assert bpe.decode(bpe.encode(empty_docs(spark), PATH), PATH).count() == 0


def test_query(spark, folder):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, folder, "documents").collect()}
    got = queries.QUERIES["op2_bpe_tree"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = PLAIN.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()




def test_round_trip_equals_both_steps(spark):
    docs = odd_docs(spark)
    steps, once = bpe.decode(bpe.encode(docs, PATH), PATH), bpe.round_trip(docs, PATH)
    assert sorted(map(str, once.select(steps.columns).collect())) == sorted(map(str, steps.collect()))


def test_pieces_that_share_a_polynomial_hash():
    """A word over two letters and its mirror word agree in every polynomial hash modulo a power of two: both keep their own ids."""
    for k in range(9, 13):
        word = "".join("ab"[i.bit_count() & 1] for i in range(1 << k))
        texts = ["x" * 16 + word, "x" * 16 + word.translate(str.maketrans("ab", "ba"))]
        ids, bound = bpe.Coder(RANKS).encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(bound, bound[1:])] == [PLAIN.encode_ordinary(t) for t in texts]


def test_long_runs_take_time_in_proportion():
    for unit in (".", "-", " ", ".-", "xy", ".-="):
        for n in (30_000, 1_000_003):
            text, began = (unit * n)[:n], time.time()
            coder = bpe.Coder(RANKS)
            ids, _ = coder.encode([text.encode()])
            assert time.time() - began < 5 and coder.decode(ids.tolist()) == text.encode()
            assert n > 50_000 or ids.tolist() == PLAIN.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=257, max_size=600) | st.text("ab.-", min_size=257, max_size=900).map(str.encode))
def test_long_merges_are_the_short_ones(data):
    long = CODER.merged(data)
    assert long == CODER.tree(data) and b"".join(CODER.table[i] for i in long) == data
    assert all(CODER.stable(a, b) for a, b in zip(long, long[1:]))
