import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_helpers import prose  # noqa: E402

from sentrace.llm.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def session(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def odd(session):
    """Documents with nulls, empty and long texts, repeated rows and ids, and names that clash with results."""
    long_ = prose(1, 30000)
    shared = prose(2, 60)
    near = prose(3, 120).split()
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, shared),
        (5, "before " + shared + " after"),
        (5, "before " + shared + " after"),
        (6, long_),
        (7, " ".join(near)),
        (8, " ".join(near[:60] + ["changed"] + near[61:])),
        (None, " ".join(near)),
        (None, None),
        (9, "One Two  three"),
        (10, "one two three"),
        (11, "ha " * 200),
        (12, prose(4, 80)),
        (12, prose(5, 80)),
        (13, "123 456 !!"),
        (14, prose(6, 36) + "\x00\u3000Ünïcode \U0001f600 " + prose(7, 5)),
    ]
    return session.createDataFrame(
        [(i, t, "en", "clash", 0.5, 7, "x", "y") for i, t in rows],
        "doc_id long, text string, lang string, text_digest string, score double, n_removed int, runs string, leaks string",
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
