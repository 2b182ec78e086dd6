"""The library stands without the folders of the llm subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/lexloom", tmp_path / "lexloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'postings_stats' in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(f"{ROOT}/lexloom"):
        for n in names:
            if n.endswith(".py") and not folder.endswith("llm"):
                assert "lexloom.llm" not in open(f"{folder}/{n}").read()
