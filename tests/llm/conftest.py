import random

import pytest


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
