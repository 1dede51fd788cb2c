import pytest

from lectern.tables import discard, local_session, shared_dir


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, 8, "6g")
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
    yield session
    discard(session, shared_dir(session))
    session.stop()
