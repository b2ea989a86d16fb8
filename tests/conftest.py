import pytest

from tools.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


FILE_DDL = "scan_id string, file_path string, content string"


@pytest.fixture(scope="session")
def files_of(spark):
    def build(rows):
        """rows: (file_path, content); every file is its own scan, named after its path."""
        return spark.createDataFrame([(p, p, c) for p, c in rows], FILE_DDL)

    return build
