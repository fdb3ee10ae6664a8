"""A trained bidirectional LSTM as a model of ONNX Runtime, which finds sigmoids and hyperbolic tangents several times
faster than numpy does. The model is written here field by field (protocol buffers), as its numbers are few.
"""

from __future__ import annotations

import numpy as np

FLOAT, INT32 = 1, 6
TYPES = {"float32": FLOAT, "int32": INT32, "int64": 7}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _tensor(name: str, a: np.ndarray) -> bytes:
    return b"".join(_field(1, n) for n in a.shape) + _field(2, TYPES[a.dtype.name]) + _field(8, name) + _field(9, np.ascontiguousarray(a).tobytes())


def _attribute(name: str, value: int | list[int] | bytes) -> bytes:
    if isinstance(value, int):
        return _field(1, name) + _field(3, value) + _field(20, 2)
    if isinstance(value, list):
        return _field(1, name) + b"".join(_field(8, v) for v in value) + _field(20, 7)
    return _field(1, name) + _field(6, value) + _field(20, 5)  # a graph


def _node(op: str, inputs: str, outputs: str, **attributes) -> bytes:
    parts = [_field(1, n) for n in inputs.split()] + [_field(2, n) for n in outputs.split()] + [_field(4, op)]
    return b"".join(parts + [_field(5, _attribute(k, v)) for k, v in attributes.items()])


def _value(name: str, shape: tuple[str | int, ...], kind: int = FLOAT) -> bytes:
    dims = b"".join(_field(1, _field(1 if isinstance(n, int) else 2, n)) for n in shape)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, dims)))


def _graph(nodes: list[bytes], inputs: list[bytes], outputs: list[bytes], fixed: dict[str, np.ndarray]) -> bytes:
    return b"".join([*(_field(1, n) for n in nodes), _field(2, "graph"), *(_field(5, _tensor(k, v)) for k, v in fixed.items()), *(_field(11, v) for v in inputs), *(_field(12, v) for v in outputs)])


def bilstm(p: dict[str, np.ndarray]) -> bytes:
    """The model of weights p: emissions e (time, batch, tags) of classes x (time, batch), from the states and cells that
    the two directions begin with, each (batch, hidden)."""
    tags, hidden = p["emit"].shape[0], p["emit"].shape[1] // 2
    state = ("batch", hidden)

    def step(d: str, w: np.ndarray) -> bytes:
        nodes = [
            _node("Gather", "table x", "shares"), _node("MatMul", "h u", "more"), _node("Add", "shares more", "z"),
            _node("Split", "z sizes", "zi zf zo zg", axis=1), _node("Sigmoid", "zi", "i"), _node("Sigmoid", "zf", "f"), _node("Sigmoid", "zo", "o"), _node("Tanh", "zg", "g"),
            _node("Mul", "i g", "new"), _node("Mul", "f c", "old"), _node("Add", "new old", "c1"), _node("Tanh", "c1", "t"), _node("Mul", "o t", "h1"), _node("MatMul", "h1 w", "e"),
        ]
        fixed = {"table": p[f"x{d}"].T, "u": p[f"h{d}"].T, "w": w.T, "sizes": np.full(4, hidden)}
        return _graph(nodes, [_value("h", state), _value("c", state), _value("x", ("batch",), INT32)], [_value("h1", state), _value("c1", state), _value("e", ("batch", tags))], fixed)

    nodes = [
        _node("Scan", "hf cf x", "hf1 cf1 ef", body=step("f", p["emit"][:, :hidden]), num_scan_inputs=1),
        _node("Scan", "hb cb x", "hb1 cb1 eb", body=step("b", p["emit"][:, hidden:]), num_scan_inputs=1, scan_input_directions=[1], scan_output_directions=[1]),
        _node("Add", "ef eb", "both"), _node("Add", "both bias", "e"),
    ]
    inputs = [_value("x", ("time", "batch"), INT32), *(_value(n, state) for n in ("hf", "cf", "hb", "cb"))]
    graph = _graph(nodes, inputs, [_value("e", ("time", "batch", tags))], {"bias": p["bias"]})
    return _field(1, 8) + _field(8, _field(2, 17)) + _field(7, graph)  # versions of the format and of its operators


def session(model: bytes):
    """Of one thread, as a task has one core; None where there is no ONNX Runtime."""
    try:
        import onnxruntime as ort
    except ImportError:
        return None
    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    return ort.InferenceSession(model, options, providers=["CPUExecutionProvider"])
