"""A tiny encoder as an ONNX file: the vector of a token is a row of a table with closed-form weights.

The file is a protocol buffer; only the few fields that such a graph needs are written.
"""

from __future__ import annotations

import numpy as np

VOCABULARY, DIM = 64, 4
_INT64, _FLOAT = 7, 1


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    raw = value.encode() if isinstance(value, str) else value
    return _number(number << 3 | 2) + _number(len(raw)) + raw


def _value(name: str, kind: int, dims: list[str]) -> bytes:
    shape = b"".join(_field(1, _field(2, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def weights() -> np.ndarray:
    i, j = np.meshgrid(np.arange(VOCABULARY), np.arange(DIM), indexing="ij")
    return (((i * 7 + j * 3) % 11 - 5) / 5).astype(np.float32)


def encoder_bytes() -> bytes:
    """Inputs ``input_ids`` and ``attention_mask``, output ``last_hidden_state``."""
    table = weights()
    tensor = b"".join(_field(1, d) for d in table.shape) + _field(2, _FLOAT) + _field(8, "table") + _field(9, table.tobytes())
    gather = _field(1, "table") + _field(1, "input_ids") + _field(2, "last_hidden_state") + _field(4, "Gather")
    graph = _field(1, gather) + _field(2, "encoder") + _field(5, tensor)
    graph += b"".join(_field(11, _value(name, _INT64, ["batch", "tokens"])) for name in ("input_ids", "attention_mask"))
    graph += _field(12, _value("last_hidden_state", _FLOAT, ["batch", "tokens", "dim"]))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))
