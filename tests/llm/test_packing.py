"""Tokenization against the library, packing against its definition."""

import collections
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from placelink.llm import bpe, packing


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab sdtmlrve'\n\t .,!?1é²ñ'  Ą中 "), max_size=40), max_size=5))
def test_ids_are_the_library_s(texts):
    enc = bpe.encoder(packing.tokenizer_path())
    ids, off = enc.encode(texts)
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want


def check_plan(counts, capacity):
    fill = collections.defaultdict(list)
    done = collections.Counter()
    for length, rank, n, first, per, offset in packing.plan(counts, capacity):
        assert rank == done[length]
        done[length] += n
        for r in range(n):
            fill[first + r // per].append((offset + (r % per) * length, length))
    assert done == collections.Counter({k: v for k, v in counts.items() if v})
    for spans in fill.values():
        at = 0
        for o, length in sorted(spans):
            assert o == at
            at += length
        assert at <= capacity
    return len(fill)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 12)))
def test_plan_is_gapless_and_whole(counts):
    check_plan(counts, 30)


def test_plan_is_near_the_bound():
    random.seed(1)
    counts = collections.Counter(min(2048, int(random.lognormvariate(6, 1))) + 1 for _ in range(5000))
    counts = {min(k, 2048): v for k, v in counts.items()}
    bound = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert check_plan(counts, 2048) <= 1.02 * bound + 1


def test_pieces_round_trip(spark):
    rows = [(3, "the word " * 3000), (1, None), (2, ""), (7, "x"), (7, "x"), (9, "é 中 'll don't")]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), 512, keep_ids=True).collect()
    enc = bpe.encoder(packing.tokenizer_path())
    want = collections.Counter((d, tuple(enc.whole([t or ""])[0] + [0])) for d, t in rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
        assert r.length == len(r.ids)
    assert tuple(np.concatenate([r.ids for r in sorted(by[3], key=lambda r: r.piece)])) == next(k for d, k in want if d == 3)
    assert len(by[7]) == 2 and len(by[1]) == len(by[2]) == 1
    spots = sorted((r.sequence_id, r.offset, r.length) for r in out)
    for a, b in zip(spots, spots[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
