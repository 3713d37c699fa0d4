"""Rows of small test frames."""

def rows(df, *cols):
    """Collect selected columns as a list of tuples (small test frames only)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
