import pytest
from cases import frame, prose

from beaconloom.llm.common import ship


@pytest.fixture(scope="session")
def lake(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, white space, marks, copies, repeated rows, a row without an id, a very long text."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "!!!"), (5, "One"), (6, "one  two"), (6, "one  two"), (7, prose(7, 60)),
        (8, prose(7, 60)), (9, prose(9, 300)), (None, "no id at all"), (11, prose(11, 30_000)), (12, "x" * 70_000),
        (13, "日本語 éé ▁a \u0000 <|endoftext|> </s>"), (14, " lead and trail  "), (-3, "negative"),
    ]


@pytest.fixture(scope="session")
def odd(lake, odd_rows):
    return frame(lake, odd_rows).repartition(3)


@pytest.fixture(scope="session")
def empty(lake):
    return frame(lake, [])
