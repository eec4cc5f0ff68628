"""All queries of this subpackage, and their SQL."""

from __future__ import annotations

import importlib
import pkgutil
import re
from pathlib import Path

_names = sorted(m.name for m in pkgutil.iter_modules([str(Path(__file__).parent)]) if re.match(r"q\d+_", m.name))
_modules = [importlib.import_module(f"{__package__}.{name}") for name in _names]
QUERIES = {name: query for m in _modules for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _modules for name, sql in getattr(m, "SQL", {}).items()}
