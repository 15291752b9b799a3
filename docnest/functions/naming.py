"""Dataset names."""

from __future__ import annotations

# Plural ending -> (letters to cut, letters to add). The first match wins.
SINGULAR_ENDINGS = (
    ("ies", 3, "y"),
    ("ses", 2, ""),
    ("xes", 2, ""),
    ("zes", 2, ""),
    ("ss", 0, ""),
    ("s", 1, ""),
)


def dataset_name(table: str) -> str:
    """The singular, lower-case name of the dataset a table is written to."""
    name = table.lower()
    for ending, cut, added in SINGULAR_ENDINGS:
        if name.endswith(ending):
            return name[: len(name) - cut] + added
    return name
