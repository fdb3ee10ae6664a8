"""The network of the personal data tagger by ONNX Runtime."""

import sys

import numpy as np
import pytest

from piiprism.llm import pii


def _windows(sizes, seed=2):
    x = np.full((max(sizes), len(sizes)), pii.PAD, np.uint8)
    rng = np.random.default_rng(seed)
    for j, n in enumerate(sizes):
        x[:n, j] = rng.integers(0, pii.PAD, n)
    return x


@pytest.mark.parametrize("sizes", [[pii.READ, 300, 40, 17], [40, 17, 33], [300]])
@pytest.mark.parametrize("runtime", [True, False])
def test_emissions_equal_the_trained_network(sizes, runtime, monkeypatch):
    """Windows may end early: what the backward direction reads of padding is then begun with."""
    if not runtime:
        monkeypatch.setitem(sys.modules, "onnxruntime", None)
    t, x = pii.Tagger(seed=3), _windows(sizes)
    got, w = t.emissions(x), t.p["emit"]
    assert (t._network()[0] is not None) == runtime
    whole = np.full((pii.READ, len(sizes)), pii.PAD, np.uint8)
    whole[: len(x)] = x
    want = w[:, : pii.HIDDEN] @ t._half("f", whole, False)[0] + w[:, pii.HIDDEN :] @ t._half("b", whole, False)[0] + t.p["bias"][:, None]
    assert got.shape == (len(x), pii.TAGS, len(sizes))
    for j, n in enumerate(sizes):
        to = min(n, pii.READ - pii.OVERLAP)
        assert np.allclose(got[pii.OVERLAP : to, :, j], want[pii.OVERLAP : to, :, j], atol=1e-4)


def test_a_changed_network_is_read_anew():
    t, x = pii.Tagger(seed=3), _windows([60, 50])
    before = t.emissions(x).copy()
    t.p["bias"] = t.p["bias"] + 1
    assert np.allclose(t.emissions(x), before + 1, atol=1e-4)
    t.p["xf"] *= 2
    assert not np.allclose(t.emissions(x), before + 1, atol=1e-2)


def test_tags_are_the_same_without_the_runtime(monkeypatch):
    t = pii.Tagger(seed=5)
    t.p["bias"][0] += 0.5
    texts = ["", "write to anna.lee [at] home [dot] org " * 40, "x", "call (212) 555-0199 " * 3, "10 . 0 . 0 . 1"]
    tagged = t.tag(texts)
    assert any(tagged)
    monkeypatch.setitem(sys.modules, "onnxruntime", None)
    t._made = (None,)
    assert t.tag(texts) == tagged and t._network()[0] is None
