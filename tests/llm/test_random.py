"""Random inputs: encoding against a public encoder, packing, canonical forms, signatures of copies."""

import base64
import os

import numpy as np
import pytest

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from lexloom.llm import p1_overlap, p2_near, p4_canonical, p7_tokens, p8_containers  # noqa: E402

TEXT = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abcdet 's\n'0123é米")), max_size=200)


@pytest.fixture(scope="module")
def encoders():
    tiktoken = pytest.importorskip("tiktoken")
    path = f"{p7_tokens.TOKENIZERS}/{p7_tokens.RANKS}"
    if not os.path.exists(path):
        pytest.skip("no tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return p7_tokens.Encoder(), tiktoken.Encoding("own", pat_str=p7_tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_ids(encoders, texts):
    own, public = encoders
    assert own.encode(texts) == [public.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_pack(sizes):
    z = np.array(sizes)
    box = p8_containers.pack(z, 100)
    fill = np.bincount(box, weights=z)
    assert (box >= 0).all() and 0 < fill.min() and fill.max() <= 100
    assert len(fill) == 1 or sum(sorted(fill)[:2]) > 100  # two containers that fit into one are never left


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abcxyz", min_size=1, max_size=5), st.text("abc XYZ.,-1", max_size=10), min_size=2, max_size=5), st.randoms())
def test_forms_of_one_record(fields, r):
    import json

    items = [(k, v) for k, v in fields.items()]
    want = p4_canonical.record_form(json.dumps(dict(items)))
    r.shuffle(items)
    assert p4_canonical.record_form(json.dumps(dict(items), indent=r.choice([None, 2]))) == want
    assert p4_canonical.record_form(r.choice([" | ", "\n"]).join(f"{k.upper()}:  {v.swapcase()}" for k, v in items)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcd ", min_size=20, max_size=60), min_size=1, max_size=12, unique=True), st.lists(st.text("abcd ", min_size=20, max_size=60), min_size=1, max_size=12, unique=True))
def test_overlaps(train, evaluation):
    w = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    want = {(i, j) for i, a in enumerate(train) for j, b in enumerate(evaluation) if len(w(a) & w(b)) >= 0.7 * len(w(a) | w(b)) - 1e-9}
    i, j, *_ = p1_overlap.pairs(train, evaluation)
    assert set(zip(i.tolist(), j.tolist())) == want


@settings(max_examples=30, deadline=None)
@given(st.text(min_size=20, max_size=300))
def test_copies_have_one_signature(text):
    sig, size = p2_near.signatures([text, text, "short"])
    assert (sig[0] == sig[1]).all() and size[0] == size[1] == len({text[i : i + 5] for i in range(len(text) - 4)})


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=2, max_size=80))
def test_one_tree_equals_many(encoders, piece):
    own, _ = encoders
    width = 1 << (len(piece) - 1).bit_length()
    assert own.merge_one(piece) == own.merge([piece, piece], width)[1]
