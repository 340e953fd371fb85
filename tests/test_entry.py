"""The entry points with and without the optional subpackage."""

import importlib
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "strandline"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "strandline" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.skipif(not (ROOT / "strandline" / "llm").exists(), reason="the subpackage isn't there")
def test_a_missing_library_is_an_error(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("strandline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    importlib.invalidate_caches()
    with pytest.raises(ImportError):
        entry.queries()
