"""A set of text positions in array, bitmap and run containers, with selection by rank."""

from __future__ import annotations

import numpy as np

#: Positions of one container.
SPAN = 1 << 16
_WORD_BITS = 64


class ArrayContainer:
    """Sparse positions, listed."""

    def __init__(self, inside: np.ndarray) -> None:
        self.at = inside.astype(np.uint16)

    def select(self, rank: int) -> int:
        return int(self.at[rank])


class RunContainer:
    """Positions in few stretches: where each starts, and how many positions lie before it."""

    def __init__(self, inside: np.ndarray, breaks: np.ndarray) -> None:
        self.start = inside[breaks].astype(np.uint16)
        self.before = breaks.astype(np.uint16)

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.start[run]) + rank - int(self.before[run])


class BitmapContainer:
    """Dense positions, one bit each; the word that holds a rank is found by the bits before it."""

    def __init__(self, mask: np.ndarray) -> None:
        bits = np.zeros(SPAN, bool)
        bits[:len(mask)] = mask
        self.words = np.packbits(bits, bitorder="little").view("<u8")

    def select(self, rank: int) -> int:
        total = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        word = int(np.searchsorted(total, rank, "right"))
        left = rank - (int(total[word - 1]) if word else 0)
        bits = np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little")
        return word * _WORD_BITS + int(np.flatnonzero(bits)[left])


class BoundarySet:
    """The positions of ``mask`` that hold: one container for each 65,536 positions, each in its smallest form.

    A listed position takes 2 bytes, a run 4, a bitmap 8,192. ``total[i]`` counts the positions in containers 0 to i.
    """

    def __init__(self, mask: np.ndarray) -> None:
        self.containers: list[ArrayContainer | RunContainer | BitmapContainer] = []
        counts = []
        for low in range(0, len(mask), SPAN):
            part = mask[low:low + SPAN]
            inside = np.flatnonzero(part)
            breaks = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
            sizes = {"run": 4 * len(breaks), "array": 2 * len(inside), "bitmap": SPAN // 8}
            form = min(sizes, key=sizes.__getitem__)
            self.containers.append(RunContainer(inside, breaks) if form == "run" else ArrayContainer(inside) if form == "array"
                                   else BitmapContainer(part))
            counts.append(len(inside))
        self.total = np.cumsum(counts, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.total[-1]) if len(self.total) else 0

    def select(self, rank: int) -> int:
        """The position with ``rank`` smaller ones in the set."""
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        box = int(np.searchsorted(self.total, rank, "right"))
        before = int(self.total[box - 1]) if box else 0
        return box * SPAN + self.containers[box].select(rank - before)
