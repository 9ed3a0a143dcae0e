"""Plain helpers of the tests."""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
