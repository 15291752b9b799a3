"""Comparing nested results."""


def plain(value):
    """Rows as dicts and lists, for comparing nested results."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


def rows(df, *order):
    """All rows as plain dicts, ordered by the named columns."""
    found = [plain(r) for r in df.collect()]
    return sorted(found, key=lambda r: tuple(r[o] for o in order)) if order else found
