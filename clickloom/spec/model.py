"""Feature kinds, offsets and dimensions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import NamedTuple


def embedding_width(size: int) -> int:
    """Numbers that represent one of ``size`` ids: 2 to the ceiling of ln(size^0.25)."""
    return int(2 ** math.ceil(math.log(size**0.25)))


@dataclass(frozen=True)
class HashBucket:
    """String category hashed into ``size`` ids; embedded for the deep input."""

    name: str
    size: int
    kind = "category"


@dataclass(frozen=True)
class Vocab:
    """String category with a closed list of values; anything else has no id."""

    name: str
    values: tuple[str, ...]
    kind = "category"

    @property
    def size(self) -> int:
        return len(self.values)


@dataclass(frozen=True)
class Identity:
    """Integer category that is its own id in [0, size); anything else becomes 0."""

    name: str
    size: int
    kind = "category"


@dataclass(frozen=True)
class Continuous:
    """Number with optional scaling (``min_max``, ``standard``, ``log``) and optional boundaries."""

    name: str
    scale: str | None = None
    params: tuple[float, float] | None = None
    boundaries: tuple[float, ...] = ()
    kind = "continuous"

    def __post_init__(self):
        if self.scale not in (None, "min_max", "standard", "log"):
            raise ValueError(f"{self.name}: unknown scaling {self.scale!r}")
        if self.scale in ("min_max", "standard") and (self.params is None or len(self.params) != 2):
            raise ValueError(f"{self.name}: {self.scale} needs two parameters")
        if list(self.boundaries) != sorted(self.boundaries):
            raise ValueError(f"{self.name}: boundaries must ascend")

    @property
    def size(self) -> int:
        return len(self.boundaries) + 1 if self.boundaries else 0


@dataclass(frozen=True)
class Cross:
    """Hash of the combinations of two or more features."""

    members: tuple[str, ...]
    size: int = 10_000
    deep: bool = True

    def __post_init__(self):
        if len(self.members) < 2:
            raise ValueError("a cross needs at least two members")

    @property
    def name(self) -> str:
        return "&".join(self.members)


Feature = HashBucket | Vocab | Identity | Continuous


class WideSlot(NamedTuple):
    """One sparse column: its ids are shifted by ``offset`` into one shared id space."""

    name: str
    size: int
    offset: int


class DeepSlot(NamedTuple):
    """One dense block of the deep input: ``how`` is ``number``, ``hot`` or ``embedding``."""

    name: str
    how: str
    width: int


@dataclass(frozen=True)
class ModelSpec:
    """All fields in file order (label first), the used features and their crosses."""

    fields: tuple[str, ...]
    features: tuple[Feature, ...]
    crosses: tuple[Cross, ...] = ()
    multivalue: bool = True
    _by_name: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def __post_init__(self):
        lowered = tuple(name.lower() for name in self.fields)
        object.__setattr__(self, "fields", lowered)
        self._by_name.update({f.name: f for f in self.features})
        unknown = [f.name for f in self.features if f.name not in lowered]
        if unknown:
            raise ValueError(f"features without a field: {unknown}")
        for cross in self.crosses:
            for member in cross.members:
                used = self._by_name.get(member)
                if used is None:
                    raise ValueError(f"cross {cross.name}: {member} is not a used feature")
                if isinstance(used, Continuous) and not used.boundaries:
                    raise ValueError(f"cross {cross.name}: {member} needs boundaries")

    @property
    def label(self) -> str:
        return self.fields[0]

    def feature(self, name: str) -> Feature:
        return self._by_name[name]

    def names(self, which: str = "all") -> list[str]:
        """Field names by role: all, used, unused, category or continuous (never the label)."""
        if which == "all":
            return list(self.fields[1:])
        if which == "used":
            return [n for n in self.fields[1:] if n in self._by_name]
        if which == "unused":
            return [n for n in self.fields[1:] if n not in self._by_name]
        if which in ("category", "continuous"):
            return [n for n in self.names("used") if self._by_name[n].kind == which]
        raise ValueError(f"unknown selection {which!r}")

    def field_type(self, name: str) -> str:
        """SQL type of a field: int for the label and identities, float for numbers, else string."""
        if name == self.label:
            return "int"
        used = self._by_name.get(name)
        if isinstance(used, Identity):
            return "int"
        return "float" if isinstance(used, Continuous) else "string"

    def wide_slots(self) -> list[WideSlot]:
        slots, offset = [], 0
        for column in [*self.features, *self.crosses]:
            if column.size:
                slots.append(WideSlot(column.name, column.size, offset))
                offset += column.size
        return slots

    def deep_slots(self) -> list[DeepSlot]:
        slots = []
        for f in self.features:
            if isinstance(f, Continuous):
                slots.append(DeepSlot(f.name, "number", 1))
            elif isinstance(f, HashBucket):
                slots.append(DeepSlot(f.name, "embedding", embedding_width(f.size)))
            else:
                slots.append(DeepSlot(f.name, "hot", f.size))
        slots += [DeepSlot(c.name, "embedding", embedding_width(c.size)) for c in self.crosses if c.deep]
        return slots

    @property
    def wide_dimension(self) -> int:
        return sum(s.size for s in self.wide_slots())

    @property
    def deep_dimension(self) -> int:
        return sum(s.width for s in self.deep_slots())
