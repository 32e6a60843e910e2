"""Parameters of a hierarchy and their checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Names of neighbour searches. All approximate ones stand for one approximate search here.
EXACT = ("exact", "FLANN")
APPROXIMATE = ("approx", "NNDescent", "KDTree_NNDescent", "ANNOY", "HNSW", "pyNNDescent")


@dataclass(frozen=True)
class Params:
    """``levels``: share of a level's points that become landmarks of the next.
    ``n_epochs`` of -1: 500 up to 10,000 rows of a layout, else 200."""

    levels: tuple[float, ...] = (0.2, 0.2)
    n_neighbors: int = 100
    min_dist: float = 0.15
    spread: float = 1.0
    knn_algorithm: str = "exact"
    init: str = "Random"
    seed: int = 42
    n_epochs: int = 500
    landmark_walks: int = 10
    landmark_steps: int = 10
    influence_walks: int = 20
    influence_steps: int = 30
    influence_neighborhood: int = 0
    fixing_term: float = 0.01

    def __post_init__(self) -> None:
        if self.knn_algorithm not in EXACT + APPROXIMATE:
            raise ValueError(f"unknown neighbour search {self.knn_algorithm!r}")
        if self.init not in ("Random", "Spectral"):
            raise ValueError("init is Random or Spectral")
        if not 0 <= self.fixing_term <= 1:
            raise ValueError("fixing_term lies between 0 and 1")
        if self.n_neighbors < 2:
            raise ValueError("n_neighbors is at least 2")
        if not all(0 < r < 1 for r in self.levels):
            raise ValueError("levels are shares between 0 and 1")
        if self.n_epochs != -1 and self.n_epochs < 1:
            raise ValueError("n_epochs is positive, or -1")

    def sizes(self, n: int) -> list[int]:
        """Rows of every level, from 0 up. Shares count as 32-bit floats."""
        out = [n]
        for r in self.levels:
            out.append(int(np.float32(r) * np.float32(out[-1])))
        return out

    def checked(self, n: int) -> list[int]:
        """``sizes``, or an error where a level has too few points for its neighbours."""
        sizes = self.sizes(n)
        for level, size in enumerate(sizes):
            if self.n_neighbors > size:
                raise ValueError(f"n_neighbors {self.n_neighbors} is more than the {size} points of level {level}")
        return sizes

    def epochs(self, rows: int) -> int:
        return self.n_epochs if self.n_epochs > 0 else 500 if rows <= 10_000 else 200
