"""Shared tables, as the rest of the library keeps them, and names for columns that stand beside a caller's."""

from collections.abc import Iterable

from lodestone.sources.shared import new_path, remove, shared_dir, stored

__all__ = ["free_names", "new_path", "remove", "shared_dir", "stored"]


def free_names(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as make it unlike all columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
