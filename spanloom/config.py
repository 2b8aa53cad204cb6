"""Parameters of builds and searches."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import ClassVar

import numpy as np

#: Documents of well-known corpora, as presets for doc_limit.
CORPORA = {"pile": 210_607_728, "openwebtext": 8_013_769, "c4": 364_868_892}


@dataclass(frozen=True)
class BuildConfig:
    """k hash functions; windows of at least t + 2 tokens; ids below doc_limit (None: all); tokens in [0, vocabulary); zone maps with
    zones of zone_interval windows for the zone_lists longest lists of a function."""

    SCHEMA: ClassVar[str] = "k int, t int, vocabulary int, doc_limit long, zone_interval int, zone_lists int, dataset string, first_seed int"

    k: int = 64
    t: int = 50
    vocabulary: int = 50_257
    doc_limit: int | None = None
    zone_interval: int = 5000
    zone_lists: int = 50_257
    dataset: str = "corpus"
    first_seed: int = 1

    def __post_init__(self) -> None:
        if self.k < 1 or self.t < 0 or self.vocabulary < 1 or self.zone_interval < 1:
            raise ValueError("k, vocabulary and zone_interval must be positive, t not negative")

    def with_(self, **changes):
        return replace(self, **changes)

    @classmethod
    def preset(cls, dataset: str, **changes) -> BuildConfig:
        return cls(dataset=dataset, doc_limit=CORPORA[dataset], **changes)

    def folder(self, parent: str) -> str:
        """Where an index with these parameters belongs; every parameter that shapes it is in the name, exactly."""
        return f"{parent.rstrip('/')}/{self.dataset}-k{self.k}-t{self.t}-v{self.vocabulary}-d{'all' if self.doc_limit is None else self.doc_limit}-s{self.first_seed}"


@dataclass(frozen=True)
class SearchConfig:
    """theta: similarity; prefix_ratio: share of lists read first (1.0: all); chunk: tokens of a query; stopwords are deleted before."""

    k: int = 64
    t: int = 50
    theta: float = 0.8
    prefix_ratio: float = 0.4
    chunk: int = 64
    sample_start: int = 0
    sample_count: int | None = None
    once: bool = False

    @property
    def matches(self) -> int:
        """Least number of collisions of a match. theta is single precision, as in the tool whose results are to be matched."""
        return int(math.ceil(np.float32(self.k) * np.float32(self.theta)))

    @property
    def prefix(self) -> int:
        return int(math.ceil(self.k * self.prefix_ratio))

    @property
    def prefix_matches(self) -> int:
        """Collisions that a match has at least among any `prefix` lists."""
        return self.prefix - (self.k - self.matches)

    def effective(self) -> SearchConfig:
        """This, or with all lists as prefix where the prefix would guarantee no collision at all."""
        return self if self.prefix_matches > 0 else replace(self, prefix_ratio=1.0)

    def levels(self) -> list[float]:
        """Similarity levels of the reports: theta, half-way to 1, and 1."""
        return sorted({self.theta, (1 - self.theta) / 2 + self.theta, 1.0})
