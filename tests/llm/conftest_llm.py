"""Plain copies of the fixtures' rows for tests that compute their own results."""

from importlib import util
from pathlib import Path

_spec = util.spec_from_file_location("llm_conftest", Path(__file__).with_name("conftest.py"))
_module = util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
edge_rows, random_texts = _module.edge_rows, _module.random_texts


def edge_texts():
    return [r[:2] for r in edge_rows()]
