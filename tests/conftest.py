import os
import sys

import pytest
from ind_samples import LETTERS, LETTERS_EXT, PERSONS, PLANETS
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("subsumo-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    content = {
        "persons.tsv": "".join("\t".join(row) + "\n" for row in PERSONS),
        "planets.tsv": "".join("\t".join(row) + "\n" for row in PLANETS),
        "letters.csv": "\n".join(LETTERS),
        "letters-ext.csv": "\n".join(LETTERS_EXT),
    }
    for name, text in content.items():
        (folder / name).write_text(text)
    return {name: str(folder / name) for name in content}
