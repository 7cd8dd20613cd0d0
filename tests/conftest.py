import json
import os

import pytest

from session_records import SF
from sessionloom.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores=8, memory="6g", spark__sql__shuffle__partitions="4", spark__sql__codegen__wholeStage="false")  # small data: compiling costs more than it saves
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def write(tmp_path):
    """Write records as a session file of a project; gives its path."""

    def put(name, records, project="-work-a", mtime=None):
        folder = tmp_path / "projects" / project
        folder.mkdir(parents=True, exist_ok=True)
        path = folder / f"{name}.jsonl"
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
        if mtime is not None:
            os.utime(path, (mtime, mtime))
        return str(path)

    put.root = str(tmp_path)
    return put
