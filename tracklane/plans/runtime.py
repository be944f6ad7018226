"""Finding the shared library that neural backends load, and loading it once in a process."""

from __future__ import annotations

import importlib.util
import os
import re
from collections.abc import Callable
from pathlib import Path

from tracklane.errors import RuntimeMissing

# The variable that names the library, and the package that may ship it.
VARIABLE, PACKAGE = "ORT_DYLIB_PATH", "onnxruntime"
#: A library by its name, with or without a version; extension modules of Python, and scripts, don't fit.
LIBRARY = re.compile(r"(lib)?onnxruntime[\d.]*\.(so|dylib|dll)(\.\d+)*")
_loaded: dict[str, bool] = {}


def packaged(package: str = PACKAGE) -> list[str]:
    """Libraries within the installed package, by name; none if it isn't installed. The package isn't imported."""
    spec = importlib.util.find_spec(package)
    places = (spec.submodule_search_locations or []) if spec else []
    return sorted(str(p) for place in places for p in Path(place, "capi").glob("*") if p.is_file() and LIBRARY.fullmatch(p.name))


def runtime_library(candidates: Callable[[], list[str]] = packaged) -> str:
    """The library that the variable names, which must exist; without the variable the first candidate that exists."""
    named = os.environ.get(VARIABLE)
    if named is not None:
        if not os.path.isfile(named):
            raise RuntimeMissing(f"{VARIABLE} names {named}, and there is no such file")
        return named
    found = next((c for c in candidates() if os.path.isfile(c)), None)
    if found is None:
        raise RuntimeMissing(f"no library of {PACKAGE} was found; install the package or name the library in {VARIABLE}")
    return found


def loaded_once(load: Callable[[str], bool], path: str | None = None) -> str:
    """The library's path after ``load``, which is called once in a process for each path; its failure is remembered."""
    path = path or runtime_library()
    if path not in _loaded:
        _loaded[path] = bool(load(path))
    if not _loaded[path]:
        raise RuntimeMissing(f"{path} was found but couldn't be loaded")
    return path
