"""Names of columns beside those of a user's table."""

from __future__ import annotations


def unused(names: list[str], like: str) -> str:
    """A column name that is none of ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    while like in taken:
        like += "_"
    return like


def quoted(name: str) -> str:
    """A column's name as it stands in an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"
