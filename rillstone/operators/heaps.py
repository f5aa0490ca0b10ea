"""Bounded stores of the online learners: largest magnitude, largest count, weighted
reservoir. Each offers the same calls; a full store hands back what it evicts."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Hashable, Iterator


class _Ranked:
    """Entries ordered by a rank, with a lazy heap: stale heap items are skipped."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("capacity must be at least 1")
        self.capacity = capacity
        self.value: dict[Hashable, float] = {}
        self.rank: dict[Hashable, tuple] = {}
        self._heap: list[tuple] = []
        self._tick = 0

    def __len__(self) -> int:
        return len(self.value)

    def __contains__(self, key: Hashable) -> bool:
        return key in self.value

    def __iter__(self) -> Iterator[Hashable]:
        return iter(self.value)

    @property
    def full(self) -> bool:
        return len(self.value) >= self.capacity

    def get(self, key: Hashable, default: float = 0.0) -> float:
        return self.value.get(key, default)

    def items(self) -> list[tuple[Hashable, float]]:
        return list(self.value.items())

    def _put(self, key: Hashable, rank: float, value: float) -> None:
        self._tick += 1
        entry = (rank, self._tick, key)
        self.rank[key], self.value[key] = entry, value
        heapq.heappush(self._heap, entry)
        if len(self._heap) > 4 * self.capacity + 64:
            self._heap = list(self.rank.values())
            heapq.heapify(self._heap)

    def first(self) -> tuple[float, Hashable]:
        """Rank and key of the entry that goes next."""
        while self.rank.get(self._heap[0][2]) is not self._heap[0]:
            heapq.heappop(self._heap)
        return self._heap[0][0], self._heap[0][2]

    def pop(self) -> tuple[Hashable, float]:
        _, key = self.first()
        del self.rank[key]
        return key, self.value.pop(key)

    def _offer(self, key: Hashable, rank: float, value: float) -> tuple[Hashable, float] | None:
        if key in self.value:
            raise KeyError(f"{key} is there already")
        out = None
        if self.full:
            if self.first()[0] > rank:
                return key, value
            out = self.pop()
        self._put(key, rank, value)
        return out


class MagnitudeHeap(_Ranked):
    """Keeps the entries of largest |value|; a newcomer wins a tie."""

    def insert(self, key: Hashable, value: float) -> tuple[Hashable, float] | None:
        return self._offer(key, abs(value), value)

    def change(self, key: Hashable, value: float) -> None:
        if key not in self.value:
            raise KeyError(key)
        self._put(key, abs(value), value)

    def insert_or_change(self, key: Hashable, value: float) -> tuple[Hashable, float] | None:
        if key in self.value:
            self.change(key, value)
            return None
        return self.insert(key, value)

    def least(self) -> float:
        return self.first()[0]


class CountHeap(_Ranked):
    """Keeps the entries of largest count, each with a value; a newcomer wins a tie."""

    def count(self, key: Hashable) -> int:
        return self.rank[key][0] if key in self.rank else 0

    def insert(self, key: Hashable, count: int, value: float) -> tuple[Hashable, float] | None:
        return self._offer(key, count, value)

    def change(self, key: Hashable, count: int, value: float) -> None:
        if key not in self.value:
            raise KeyError(key)
        if self.rank[key][0] == count:
            self.value[key] = value
        else:
            self._put(key, count, value)

    def increment(self, key: Hashable) -> None:
        self._put(key, self.rank[key][0] + 1, self.value[key])

    def insert_or_change(self, key: Hashable, count: int, value: float) -> tuple[Hashable, float] | None:
        if key in self.value:
            self.change(key, count, value)
            return None
        return self.insert(key, count, value)


class WeightedReservoir(_Ranked):
    """Keeps the entries of least |value|^power * ln(u) for a uniform u of each key.

    When a value changes its key is scaled by |new / old|^power; from 0 it is drawn
    anew. `uniform` gives numbers in (0, 1].
    """

    def __init__(self, capacity: int, uniform: Callable[[], float], power: float = 1.0):
        super().__init__(capacity)
        self.uniform, self.power = uniform, power

    def _key(self, value: float) -> float:
        return abs(value) ** self.power * math.log(self.uniform())

    def insert(self, key: Hashable, value: float) -> tuple[Hashable, float] | None:
        return self._offer(key, -self._key(value), value)

    def change(self, key: Hashable, value: float) -> None:
        if key not in self.value:
            raise KeyError(key)
        old = self.value[key]
        rank = self.rank[key][0] * abs(value / old) ** self.power if old else -self._key(value)
        self._put(key, rank, value)

    def insert_or_change(self, key: Hashable, value: float) -> tuple[Hashable, float] | None:
        if key in self.value:
            self.change(key, value)
            return None
        return self.insert(key, value)


class TokenReservoir:
    """A uniform sample of a stream with multiplicity, of bounded size."""

    def __init__(self, capacity: int, uniform: Callable[[], float]):
        self.capacity, self.uniform, self.seen = capacity, uniform, 0
        self.slots: list[str] = []

    def update(self, token: str) -> None:
        self.seen += 1
        if len(self.slots) < self.capacity:
            self.slots.append(token)
        else:
            at = int(self.uniform() * self.seen)
            if at < self.capacity:
                self.slots[at] = token

    def sample(self) -> str:
        return self.slots[min(int(self.uniform() * len(self.slots)), len(self.slots) - 1)]
