from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary files")
ODD = ["", " ", "a", "\n\n  x", "don't we'll I'VE", "<|endoftext|>", "Ⅷ ² ½ 12３", "naïve—“x”", "日本語の文", "a" * 3000, "  　 x\x1c\x1dy", "😀👍🏽", "_a__b_", "𐐷 𝒳", "\x00\x7f", "x  \t y"]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    return tokens.Encoder(tokens.Merges(tokens.VOCABULARY)), t


def ids(encoder, texts):
    flat, sizes = encoder.encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


def test_odd_texts(both):
    encoder, t = both
    assert ids(encoder, ODD) == [t.encode(x, add_special_tokens=False).ids for x in ODD]
    assert encoder.lengths(ODD).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text(both, texts):
    encoder, t = both
    assert ids(encoder, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (1, "a b")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encode(df).collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert tokens.encode(df.filter("false")).count() == 0


def test_packing(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 3000)
    where, fill = packing.pack(sizes, 100)
    assert fill.max() <= 100 and np.array_equal(np.bincount(where, sizes).astype(int), fill)
    assert len(fill) <= 1.03 * sizes.sum() / 100
    rows = [(i, int(s)) for i, s in enumerate(sizes[:200])] + [(900, 0), (901, None), (902, 250), (903, 100), (903, 100)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = packing.containers(df, 100).collect()
    per = Counter()
    for r in got:
        per[r["container_id"]] += r["n_tokens"]
    assert max(per.values()) <= 100 and sum(per.values()) == sum(s or 0 for _, s in rows)
    assert sorted((r["piece_no"], r["start_token"], r["n_tokens"]) for r in got if r["doc_id"] == 902) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert {r["doc_id"] for r in got} == {i for i, _ in rows} and len(got) == len(rows) + 2
    assert packing.containers(df.filter("false"), 100).count() == 0
    with pytest.raises(ValueError):
        packing.containers(df, 0)
