"""What several test modules use."""


def rows(df):
    """Rows as sorted tuples, for frames without an order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
