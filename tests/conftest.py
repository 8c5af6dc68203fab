import pytest

from supportlake.session import FOLDER_SETTING, local_session, remove_run_dirs


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    remove_run_dirs(session)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.conf.get(FOLDER_SETTING, None):
        spark.conf.set(FOLDER_SETTING, str(tmp_path_factory.mktemp("shared")))
