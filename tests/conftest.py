import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from dialogprep.session import ensure_checkpoint_dir

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not (s.sparkContext.getCheckpointDir() or s.conf.get("spark.checkpoint.dir", None)):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dialogprep-test-"))
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def tok():
    from dialogprep.functions import CodepointTokenizer

    return CodepointTokenizer()


def make_examples(spark, records):
    """records: list of (example_id, [(speaker, utterance)], [keywords], output)."""
    from dialogprep.schema import EXAMPLE_SCHEMA

    rows = [(i, ([{"speaker": s, "utterance": u} for s, u in conv], kw), out) for i, conv, kw, out in records]
    return spark.createDataFrame(rows, EXAMPLE_SCHEMA)
