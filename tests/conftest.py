import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from arbolex.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, partitions=4)
    yield session
    session.stop()


SENTS = "sent_id long, n int, forms array<string>, upos array<int>, heads array<int>, deprels array<int>"


@pytest.fixture
def sentences(spark):
    """Nested sentences from (heads, deprels) pairs, ids from 1."""

    def build(*trees):
        rows = []
        for i, tree in enumerate(trees, 1):
            heads, deprels = tree if isinstance(tree, tuple) else (tree, None)
            n = len(heads)
            labels = deprels or [1 if h == 0 else 2 + j % 5 for j, h in enumerate(heads)]
            rows.append((i, n, [f"w{j}" for j in range(n)], [1 + j % 17 for j in range(n)], list(heads), labels))
        return spark.createDataFrame(rows, SENTS)

    return build
