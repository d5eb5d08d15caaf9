"""Helpers shared by the test modules."""


def rows(df, *cols, order=None):
    """Collect small test results as tuples (sorted for comparison)."""
    cols = cols or tuple(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t)) if order is None else out
