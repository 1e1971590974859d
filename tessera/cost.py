"""Costs in one currency: bytes, seconds of work and waiting, and what they are worth."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

GB = 1e9
MONTH_SECONDS = 30 * 86400.0


class Tier(str, Enum):
    HOT = "hot"
    COLD = "cold"


class Distance(str, Enum):
    LOCAL = "local"
    NEAR = "near"
    FAR = "far"


@dataclass(frozen=True)
class Link:
    """One request's latency, and bytes a second."""

    latency_s: float
    bytes_s: float

    def seconds(self, bytes: float, requests: int) -> float:
        return requests * self.latency_s + bytes / self.bytes_s


#: What links of each distance give.
LINKS = {Distance.LOCAL: Link(100e-6, 2e9), Distance.NEAR: Link(20e-3, 90e6), Distance.FAR: Link(80e-3, 40e6)}


@dataclass(frozen=True)
class Cost:
    bytes: float = 0.0
    cpu_s: float = 0.0
    wait_s: float = 0.0
    usd: float = 0.0

    def __add__(self, other: Cost) -> Cost:
        return Cost(self.bytes + other.bytes, self.cpu_s + other.cpu_s, self.wait_s + other.wait_s, self.usd + other.usd)


@dataclass(frozen=True)
class Rates:
    """A provider's list prices."""

    request_usd: float
    egress_gb_usd: float
    retrieval_gb_usd: float
    storage_gb_month_usd: float
    cpu_hour_usd: float
    request_bytes: float = 8e6


@dataclass(frozen=True)
class PriceTable:
    """Dollars for a byte read (hot and local), factors for tier and distance, for a byte kept a day, and for a second of work."""

    hot_byte: float
    cold_factor: float
    near_factor: float
    far_factor: float
    byte_day: float
    cpu_second: float

    @classmethod
    def from_rates(cls, r: Rates) -> PriceTable:
        hot = r.request_usd / r.request_bytes
        factor = lambda gb_usd: (hot + gb_usd / GB) / hot if hot else 1.0
        return cls(hot, factor(r.retrieval_gb_usd), 1.0, factor(r.egress_gb_usd), r.storage_gb_month_usd / GB / 30, r.cpu_hour_usd / 3600)

    def byte_usd(self, tier: Tier = Tier.HOT, distance: Distance = Distance.LOCAL) -> float:
        return self.hot_byte * (self.cold_factor if tier is Tier.COLD else 1.0) * {Distance.LOCAL: 1.0, Distance.NEAR: self.near_factor, Distance.FAR: self.far_factor}[distance]

    def price(self, bytes: float, tier: Tier = Tier.HOT, distance: Distance = Distance.LOCAL, requests: int = 1, cpu_s: float = 0.0) -> Cost:
        return Cost(bytes, cpu_s, LINKS[distance].seconds(bytes, requests), bytes * self.byte_usd(tier, distance) + cpu_s * self.cpu_second)

    def retention_usd(self, bytes: float, days: float) -> float:
        return bytes * self.byte_day * days

    def wait_seconds(self, bytes: float, distance: Distance = Distance.LOCAL, requests: int = 1, at_once: int = 1) -> float:
        return LINKS[distance].seconds(bytes, requests) / max(1, min(requests, at_once))


#: A hot byte, the factors, a byte-day.
CLOUD = PriceTable(4.0e-13, 26.0, 1.0, 51.0, 7.67e-13, 0.04 / 3600)
ON_PREMISES = replace(CLOUD, cold_factor=1.0, far_factor=1.0)
FREE_READS = replace(CLOUD, hot_byte=0.0)


# --- places -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Place:
    """Where something is, from the widest area down: region/zone/host."""

    parts: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str) -> Place:
        return cls(tuple(p for p in text.split("/") if p))

    def distance(self, other: Place) -> Distance:
        """Same place: local; same widest area: near; anything else, unknown places too: far."""
        if not self.parts or not other.parts:
            return Distance.FAR
        if self.parts == other.parts:
            return Distance.LOCAL
        return Distance.NEAR if self.parts[0] == other.parts[0] else Distance.FAR


@dataclass(frozen=True)
class Fact:
    tier: Tier = Tier.HOT
    distance: Distance = Distance.FAR
    assumed: bool = True


class StorageFacts:
    """Tier and distance of objects by the longest prefix that is known; otherwise hot, far and marked as assumed."""

    def __init__(self, here: Place | None = None):
        self.here = here or Place()
        self._known: dict[str, Fact] = {}

    def declare(self, prefix: str, tier: Tier, place: Place) -> None:
        self._known[prefix] = Fact(tier, self.here.distance(place), False)

    def resolve(self, path: str) -> Fact:
        found = [p for p in self._known if path.startswith(p)]
        return self._known[max(found, key=len)] if found else Fact()


# --- budgets ----------------------------------------------------------------------------------------------------------


class BudgetExceeded(RuntimeError):
    """A query over its budget fails; it never returns part of its rows."""


@dataclass(frozen=True)
class Budget:
    bytes: float | None = None
    usd: float | None = None

    def breach(self, spent: Cost) -> str | None:
        """Bytes are named first; only more than the limit is a breach."""
        if self.bytes is not None and spent.bytes > self.bytes:
            return f"bytes {spent.bytes:.0f} > {self.bytes:.0f}"
        if self.usd is not None and spent.usd > self.usd:
            return f"usd {spent.usd:.3g} > {self.usd:.3g}"
        return None


class Meter:
    """Charges first, then checks; once stopped it stays so."""

    def __init__(self, budget: Budget | None = None, prices: PriceTable = CLOUD, at_once: int = 1):
        self.budget, self.prices, self.at_once = budget or Budget(), prices, at_once
        self.spent, self.reads, self.stopped = Cost(), 0, None

    def charge(self, bytes: float, tier: Tier = Tier.HOT, distance: Distance = Distance.LOCAL, requests: int = 1) -> None:
        if self.stopped:
            raise BudgetExceeded(self.stopped)
        self.spent += self.prices.price(bytes, tier, distance, requests)
        self.reads += requests
        if breach := self.budget.breach(self.spent):
            self.stopped = breach
            raise BudgetExceeded(breach)

    @property
    def wait_s(self) -> float:
        return self.spent.wait_s / max(1, min(self.reads, self.at_once))


# --- layouts ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Spread:
    """How a column's values lie over a table's files: how many files hold a value, and how many min/max alone would leave."""

    files: int
    per_value: float
    by_bounds: float

    @classmethod
    def from_bounds(cls, bounds: list[tuple[float, float] | None], overlap: float | None = None) -> Spread | None:
        """From each file's (min, max). A value in the middle of a file's range is left in every file whose range covers it."""
        known = [b for b in bounds if b is not None]
        if not known:
            return None
        left = sum(sum(lo <= (b[0] + b[1]) / 2 <= hi for lo, hi in known) for b in known) / len(known) + len(bounds) - len(known)
        held = left if overlap is None else min(left, 1 + overlap * (len(bounds) - 1))
        return cls(len(bounds), held, left)

    def index_advantage(self) -> float:
        """The share of all bytes that an index saves beyond what the bounds save."""
        return max(0.0, (self.by_bounds - self.per_value) / self.files) if self.files else 0.0
