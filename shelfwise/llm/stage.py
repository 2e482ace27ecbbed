"""Written tables between steps, in the shared folder the session names."""

from __future__ import annotations

from shelfwise.sources.staging import stage, stage_path

__all__ = ["free_name", "stage", "stage_path"]


def free_name(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column has it in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
