"""What a run is told, checked when it is made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from synblock.operators.synteny import Settings


@dataclass(frozen=True)
class Params:
    """Genomes, their ploidies, and the thresholds of every step."""

    genomes: tuple[str, ...]
    ploidy: dict[str, int] = field(default_factory=dict)
    outgroup: tuple[str, ...] = ()
    block_size: int = 5
    n_gaps: int = 5
    block_radius: int | None = None
    buffer: int = 100
    max_places: int | None = None
    only_og_anchors: bool = True
    secondary_hits: int = 0
    same_chromosomes: bool = False
    use_hogs: bool = True
    max_place_per_chr: int = 2
    min_share: float = 0.75

    def __post_init__(self) -> None:
        ids = [g for g in self.genomes if g not in self.outgroup]
        if len(ids) < 1 or len(set(self.genomes)) != len(self.genomes):
            raise ValueError("genomes must be given, each once")
        for g in self.genomes:
            if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.]*", g):
                raise ValueError(f"genome names are letters, digits, '_' and '.', and don't start with '.': {g!r}")
        for g, p in self.ploidy.items():
            if g not in self.genomes or not isinstance(p, int) or p < 1:
                raise ValueError(f"ploidy must be a whole number of 1 or more for a genome of the run: {g!r}: {p!r}")
        for name in ("block_size", "n_gaps", "buffer", "max_place_per_chr"):
            checked_integer(getattr(self, name), 1, name=name)
        if not 0 <= self.min_share <= 1:
            raise ValueError("min_share must be between 0 and 1")

    @property
    def places(self) -> int:
        return self.max_places if self.max_places is not None else 8 * max([1, *self.ploidy.values()])

    def settings(self) -> Settings:
        return Settings(only_og=self.only_og_anchors, block_size=self.block_size, n_gaps=self.n_gaps, buffer=self.buffer, block_radius=self.block_radius or 5 * self.block_size, same_chromosomes=self.same_chromosomes)

    def second(self) -> Settings | None:
        if not self.secondary_hits:
            return None
        return Settings(only_og=False, block_size=self.block_size, n_gaps=2 * self.n_gaps, buffer=self.buffer, block_radius=self.block_radius or 5 * self.block_size, top1=self.secondary_hits, top2=self.secondary_hits)


def pairs(spark: SparkSession, params: Params) -> DataFrame:
    """A row per pair of genomes, itself included, in the order of the run: how many hits a gene may seed with on either side, and the thresholds."""
    s, kept = params.settings(), [g for g in params.genomes if g not in params.outgroup]
    n = lambda g: params.ploidy.get(g, 1)
    rows = [(a, b, a == b, n(b), n(a), s.block_size, s.n_gaps, s.block_radius, s.radius) for i, a in enumerate(kept) for b in kept[i:]]
    return spark.createDataFrame(rows, "query string, target string, isSelf boolean, nTargets int, nQueries int, blkSize int, nGaps int, blkRadius int, synRad double")


def checked_integer(x, low: float = float("-inf"), high: float = float("inf"), default: int | None = None, name: str = "value") -> int:
    """A whole number clamped to [low, high]; what isn't one gives the default, or an error without it."""
    try:
        n = int(x)
    except (TypeError, ValueError):
        if default is None:
            raise ValueError(f"{name} must be a whole number: {x!r}") from None
        n = default
    if default is None and not low <= n <= high:
        raise ValueError(f"{name} must be between {low} and {high}: {n}")
    return int(min(max(n, low), high))


def checked_number(x, low: float = float("-inf"), high: float = float("inf"), default: float | None = None, name: str = "value") -> float:
    try:
        n = float(x)
    except (TypeError, ValueError):
        if default is None:
            raise ValueError(f"{name} must be a number: {x!r}") from None
        n = default
    return min(max(n, low), high)


def checked_text(x, choices: tuple[str, ...] | None = None, default: str | None = None, name: str = "value") -> str:
    if x is None or (choices and str(x) not in choices):
        if default is None:
            raise ValueError(f"{name} must be one of {choices}: {x!r}" if choices else f"{name} is missing")
        return default
    return str(x)


def checked_flag(x, default: bool | None = None, name: str = "value") -> bool:
    if isinstance(x, bool):
        return x
    if str(x).lower() in ("true", "t", "1", "yes"):
        return True
    if str(x).lower() in ("false", "f", "0", "no"):
        return False
    if default is None:
        raise ValueError(f"{name} must be true or false: {x!r}")
    return default
