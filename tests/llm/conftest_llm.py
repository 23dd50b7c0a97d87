"""Plain names for the test modules; pytest does not let them import a conftest."""

import importlib.util
from pathlib import Path

_spec = importlib.util.spec_from_file_location("_llm_fixtures", Path(__file__).with_name("conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
NASTY, WORD, LONG, COPY, SF_DIR = (
    _module.NASTY, _module.WORD, _module.LONG, _module.COPY, _module.SF_DIR,
)
