"""One session for all tests."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from mentionmill.session import build_session

    s = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
        spark__sql__streaming__checkpoint__deletedFileCleanup="true",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
