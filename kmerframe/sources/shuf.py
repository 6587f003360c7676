"""The binary permutation file: int32 id, k, subk, level, then an int32 rank for each dimension."""

from __future__ import annotations

import hashlib

import numpy as np

from ..plans.params import GivenPermutation, SketchParams


def ranks_of(p: SketchParams) -> np.ndarray:
    digests = np.array([hashlib.md5(f"{p.seed}:{d}".encode()).hexdigest() for d in range(p.dims)], dtype="S32")
    out = np.empty(p.dims, np.int32)
    out[np.argsort(digests, kind="stable")] = np.arange(p.dims, dtype=np.int32)
    return out


def write_shuf(path: str, p: SketchParams, shuf_id: int = 1) -> None:
    with open(path, "wb") as f:
        np.array([shuf_id, p.k, p.subk, p.level], "<i4").tofile(f)
        ranks_of(p).astype("<i4").tofile(f)


def read_shuf(path: str) -> tuple[dict, np.ndarray]:
    if not path.endswith(".shuf"):
        raise ValueError("a permutation file ends in .shuf")
    raw = np.fromfile(path, "<i4")
    head = dict(zip(("shuf_id", "k", "subk", "level"), raw[:4].tolist(), strict=True))
    if len(raw) != 4 + 16 ** head["subk"]:
        raise ValueError("the permutation is not of the length its header tells")
    return head, raw[4:]


def params_of(path: str) -> GivenPermutation:
    """Parameters of a permutation file. Their seed names the permutation by the hash of its ranks."""
    head, ranks = read_shuf(path)
    plain = SketchParams(head["k"], head["subk"], head["level"])
    dims = np.flatnonzero(ranks < plain.kept).astype(np.int64)
    seed = "shuf-" + hashlib.md5(ranks.tobytes()).hexdigest()
    return GivenPermutation(plain.k, plain.subk, plain.level, seed, dims.tobytes(), ranks[dims].astype(np.int64).tobytes())
