import pytest

from weftgraph.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 2)
    # tiny inputs: compiling each plan would take longer than running it
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
