"""Typed definitions of tables and indexes, for callers that do not write SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

from tidemark.plans.session import EngineSession


class Unsupported(Exception):
    pass


@dataclass
class CreateTable:
    name: str
    columns: list[tuple[str, str]]
    primary_key: list[str] = field(default_factory=list)

    def text(self) -> str:
        parts = [f"{n} {t}" for n, t in self.columns] + ([f"PRIMARY KEY ({', '.join(self.primary_key)})"] if self.primary_key else [])
        return f"CREATE TABLE {self.name} ({', '.join(parts)})"


@dataclass
class DropTable:
    name: str

    def text(self) -> str:
        return f"DROP TABLE {self.name}"


@dataclass
class CreateIndex:
    name: str
    table: str
    columns: list[str]
    unique: bool = False

    def text(self) -> str:
        return f"CREATE {'UNIQUE ' * self.unique}INDEX {self.name} ON {self.table} ({', '.join(self.columns)})"


@dataclass
class DropIndex:
    name: str

    def text(self) -> str:
        return f"DROP INDEX {self.name}"


@dataclass
class AddColumn:
    table: str
    name: str
    type: str

    def text(self) -> str:
        return f"ALTER TABLE {self.table} ADD COLUMN {self.name} {self.type}"


@dataclass
class DropColumn:
    table: str
    name: str

    def text(self) -> str:
        return f"ALTER TABLE {self.table} DROP COLUMN {self.name}"


@dataclass
class AlterColumn:
    table: str
    name: str
    type: str


@dataclass
class RenameTable:
    name: str
    to: str


@dataclass
class RenameColumn:
    table: str
    name: str
    to: str


def apply(session: EngineSession, change) -> None:
    """Runs a definition; renames and changes of type are reported as unsupported."""
    if not hasattr(change, "text"):
        raise Unsupported(type(change).__name__)
    session.sql(change.text())
