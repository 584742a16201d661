"""What a retention job is told: policies, foreign keys, columns and the frozen plan of a run."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta


@dataclass(frozen=True)
class Column:
    name: str
    native_type: str
    nullable: bool = True


@dataclass(frozen=True)
class Policy:
    """Rows of table whose time_col is older than retention_days are archived, if equals (column, value) holds for them."""

    name: str
    table: str
    key: str
    time_col: str
    retention_days: int
    equals: tuple[str, str] | None = None
    batch_size: int = 1000

    def __post_init__(self) -> None:
        if self.retention_days < 1 or not 1 <= self.batch_size <= 1000:
            raise ValueError("retention is at least one day, a batch 1 to 1000 rows")


@dataclass(frozen=True)
class ForeignKey:
    name: str
    child: str
    child_cols: tuple[str, ...]
    parent: str
    parent_cols: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.child_cols or len(self.child_cols) != len(self.parent_cols):
            raise ValueError("a foreign key pairs its columns")


@dataclass(frozen=True)
class Plan:
    """A policy with its cutoff and upper key fixed, so that a resumed run selects the same rows."""

    policy: Policy
    cutoff: datetime
    upper_key: int | str | None = None

    @classmethod
    def freeze(cls, policy: Policy, as_of: datetime) -> Plan:
        return cls(policy, as_of - timedelta(days=policy.retention_days))

    def below(self, upper_key: int | str | None) -> Plan:
        return replace(self, upper_key=upper_key)


def group_order(tables: list[str], fks: list[ForeignKey]) -> list[str]:
    """The tables with every parent before its children; of equals, in the order given.

    2 to 32 different tables; a key that leaves the group, points at its own table or closes a cycle is refused.
    """
    if not 2 <= len(tables) <= 32 or len(set(tables)) != len(tables):
        raise ValueError("a group has 2 to 32 different tables")
    parents: dict[str, set[str]] = {t: set() for t in tables}
    for fk in fks:
        if fk.child not in parents or fk.parent not in parents:
            raise ValueError(f"{fk.name} leaves the group")
        if fk.child == fk.parent:
            raise ValueError(f"{fk.name} points at its own table")
        parents[fk.child].add(fk.parent)
    order: list[str] = []
    while len(order) < len(tables):
        ready = [t for t in tables if t not in order and parents[t] <= set(order)]
        if not ready:
            raise ValueError("the foreign keys form a cycle")
        order += ready
    return order
