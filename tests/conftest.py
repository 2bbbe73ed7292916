import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from agoralens.session import local_session, remove_intermediates  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    settings = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.checkpoint.dir": shared}
    session = local_session("tests", "8", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_intermediates(session)
    assert not [name for name in os.listdir(shared) if name.startswith("agoralens")]
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


COMMENT_COLUMNS = (
    "comment_id string, text string, subreddit string, score bigint, created_utc timestamp, "
    "post_id string, author string, controversiality int, is_submitter boolean, listing string"
)


@pytest.fixture
def make_comments(spark):
    """Comments from dicts; fields that are left out get a default."""

    def make(rows):
        from datetime import datetime

        defaults = {
            "text": "a text that is long enough to be kept", "subreddit": "python", "score": 0,
            "created_utc": datetime(2024, 1, 1), "post_id": "p1", "author": "ann", "controversiality": 0,
            "is_submitter": False, "listing": "hot",
        }
        names = [c.split()[0] for c in COMMENT_COLUMNS.split(", ")]
        full = [{**defaults, "comment_id": f"c{i}", **row} for i, row in enumerate(rows)]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], COMMENT_COLUMNS)

    return make
