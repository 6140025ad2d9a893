"""Words as search terms: runs of letters and digits, without case."""

from __future__ import annotations

import numpy as np

from casework.llm import blocks

_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False


class Terms(blocks.Words):
    """Words of ASCII letters and digits and of bytes from 128 on; A-Z count as a-z."""

    breaks = _BREAK

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets, lower=True)

    @classmethod
    def of(cls, texts: list[str]) -> Terms:
        raw = [t.encode() for t in texts]
        return cls(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))

    def names(self, seed: int = 3) -> np.ndarray:
        return super().names(seed)
