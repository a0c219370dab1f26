"""Helpers of the tests, under a name of their own (several folders have a conftest)."""

import os

SF_SMALL = "/root/testdata/sf0.001"


def write_text(path: str, text: str) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def rows(df, order=None):
    d = df.orderBy(*order) if order else df
    return [r.asDict() for r in d.collect()]
