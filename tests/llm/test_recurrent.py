"""Gradients of the recurrent layer and of the networks against differences."""

import numpy as np

from tabweave.llm import language, recurrent, toxicity


def test_layer_gradients():
    rng = np.random.default_rng(0)
    layer = recurrent.BiGru(3, rng)
    for k in layer.params:
        layer.params[k] = rng.normal(0, 0.5, layer.params[k].shape)
    x = rng.normal(size=(5, 2, 4, 9))
    weight = rng.normal(size=(5, 2, 4, 3))

    def value():
        return float((layer.forward(x)[0].astype(float) * weight).sum())

    states, kept = layer.forward(x, keep=True)
    to_inputs, grads = layer.backward(weight.astype(np.float32), kept)
    targets = [(x, to_inputs, (1, 0, 2, 4)), (x, to_inputs, (3, 1, 0, 8))]
    targets += [(layer.params["recurrent"], grads["recurrent"], (1, 2, 7)),
                (layer.params["recurrent"], grads["recurrent"], (0, 1, 3)),
                (layer.params["bias"], grads["bias"], (0, 0, 5))]
    for array, grad, at in targets:
        old, step = array[at], 1e-2
        array[at] = old + step
        up = value()
        array[at] = old - step
        down = value()
        array[at] = old
        assert abs((up - down) / (2 * step) - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_attention_gradients():
    rng = np.random.default_rng(1)
    net = toxicity.WordNet()
    table = rng.normal(size=(2, 7, 3 * toxicity.HIDDEN)).astype(np.float32)
    places = rng.integers(0, 7, (3, toxicity.WINDOW))
    places[:, :5] = 1 + places[:, :5] % 6
    error = rng.normal(size=3).astype(np.float32)
    _, cache = net.pooled(places, table, keep=True)
    grads, to_inputs = net.gradients(error, places, cache)

    def value():
        return float((net.pooled(places, table)[0] * error).sum())

    for name, at in (("query", 2), ("out", 5), ("out_bias", 0)):
        array = net.params[name]
        old = array[at]
        array[at] = old + 1e-2
        up = value()
        array[at] = old - 1e-2
        down = value()
        array[at] = old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 3e-2
    summed = recurrent.scatter_rows(places.T.reshape(-1), to_inputs[:, 0].reshape(-1, table.shape[2]), 7)
    old = table[0, 3, 4]
    table[0, 3, 4] = old + 1e-2
    up = value()
    table[0, 3, 4] = old - 1e-2
    down = value()
    table[0, 3, 4] = old
    assert abs((up - down) / 2e-2 - summed[3, 4]) < 3e-2


def test_segments_cover_every_byte():
    flat = np.arange(1, 201, dtype=np.uint8)
    offsets = np.array([0, 0, 130, 131, 200])
    segments, owner = language.segments_of(flat, offsets)
    assert owner.tolist() == [1, 1, 1, 2, 3, 3]
    assert segments[segments != language.PAD].tolist() == flat.tolist()


def test_windows_cover_every_word():
    for n in (0, 1, 16, 17, 32, 33, 48, 49, 1000):
        spans = toxicity.windows_of(n)
        assert set().union(*(range(a, b) for a, b in spans)) == set(range(n)) if n else not spans
        assert all(b - a <= toxicity.WINDOW for a, b in spans)
        assert all(b - toxicity.STRIDE == c for (_, b), (c, _) in zip(spans, spans[1:]))
