"""Reader of safetensors files: small model weights, read on the driver and broadcast by the embedders."""

from __future__ import annotations

import json

import numpy as np

MAX_HEADER = 100 << 20
_KINDS = {"F32": np.dtype("<f4"), "F16": np.dtype("<f2")}


def read_tensors(data: bytes) -> dict[str, dict]:
    """Name to {dtype, shape, data}; the metadata entry is left out. Raises ValueError on a broken header."""
    if len(data) < 8:
        raise ValueError("too short for a header")
    size = int.from_bytes(data[:8], "little")
    if size > MAX_HEADER or 8 + size > len(data):
        raise ValueError("header length is out of range")
    head = json.loads(data[8 : 8 + size])
    body = memoryview(data)[8 + size :]
    out = {}
    for name, entry in head.items():
        if name != "__metadata__":
            a, b = entry["data_offsets"]
            if not 0 <= a <= b <= len(body):
                raise ValueError(f"{name}: offsets are out of range")
            out[name] = {"dtype": entry["dtype"], "shape": entry["shape"], "data": body[a:b]}
    return out


def float_tensor(tensors: dict[str, dict], name: str) -> np.ndarray:
    """A tensor as float32; half floats keep signed zeros, subnormals, infinities and NaN."""
    if name not in tensors:
        raise KeyError(name)
    t = tensors[name]
    kind = _KINDS.get(t["dtype"])
    if kind is None:
        raise ValueError(f"{name}: {t['dtype']} is not supported")
    if int(np.prod(t["shape"])) * kind.itemsize != len(t["data"]):
        raise ValueError(f"{name}: size does not fit the shape")
    return np.frombuffer(t["data"], kind).astype(np.float32).reshape(t["shape"])
