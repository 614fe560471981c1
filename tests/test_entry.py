"""The driver contract holds with and without the optional training-data modules."""
import os
import shutil
import subprocess
import sys

import pytest

from dosewise.plans import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_optional_modules(tmp_dir):
    shutil.copytree(os.path.join(ROOT, "dosewise"), os.path.join(tmp_dir, "dosewise"),
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_dir)
    code = ("import __spark_entry__ as e; from dosewise.plans import catalog; "
            "assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.SQL)")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_dir, check=True, env=os.environ | {"PYTHONPATH": tmp_dir})


def test_nothing_else_imports_the_optional_modules():
    for top, _, names in os.walk(os.path.join(ROOT, "dosewise")):
        if os.path.basename(top) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "dosewise.llm" not in open(os.path.join(top, n)).read(), n


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return {}


class _Conf:
    def get(self, key, default=None):
        return default


class _Session:
    def __init__(self, master):
        self.sparkContext, self.conf = _Context(master), _Conf()


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Session(master))
