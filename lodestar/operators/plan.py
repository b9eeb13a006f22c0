"""What a ranking is made for."""

from __future__ import annotations

from dataclasses import dataclass, field

from lodestar.functions import vocabulary as V


@dataclass(frozen=True)
class Plan:
    """Query text, groups of skills and their weights, titles, places, years (least, target, most), notice."""

    query: str = V.DEFAULT_QUERY
    must: dict[str, list[str]] = field(default_factory=lambda: V.MUST)
    weights: dict[str, float] = field(default_factory=lambda: V.MUST_WEIGHTS)
    nice: dict[str, list[str]] = field(default_factory=lambda: V.NICE)
    titles: dict[str, float] = field(default_factory=lambda: V.TITLES)
    places: tuple[str, ...] = tuple(V.PLACES)
    years: tuple[float, float, float] = (5.0, 7.0, 9.0)
    notice_days: int = 30

    @property
    def default(self) -> bool:
        return self == DEFAULT

    @property
    def backend_first(self) -> bool:
        return "backend engineer" in next(iter(self.titles), "")


DEFAULT = Plan()
