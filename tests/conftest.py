import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from topicweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[4]",
        shuffle_partitions=4,
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TEXTS = [
    (1, "a", "red apple green apple pear"),
    (2, "a", "apple pear plum plum"),
    (3, "a", "green pear apple plum"),
    (4, "b", "engine wheel brake wheel"),
    (5, "b", "wheel engine road brake"),
    (6, "b", "road engine engine brake apple"),
    (7, "c", "!!! ..."),
    (8, "c", ""),
]


@pytest.fixture(scope="session")
def corpus(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, screen_name string, full_text string")
    from topicweave.sources.corpus import with_edited_text

    return with_edited_text(rows)
