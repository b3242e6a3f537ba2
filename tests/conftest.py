import os

import pytest


@pytest.fixture(scope="session")
def spark(pytestconfig):
    from lumenspan.session import local_session

    # Python workers import the package from the repository.
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(pytestconfig.rootpath), os.environ.get("PYTHONPATH")]))
    session = local_session(cores=4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session
