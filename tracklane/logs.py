"""Log output of this package."""

from __future__ import annotations

import logging
import os
import sys

#: Levels by logger, as in ``debug`` or ``warning,tracklane.plans=debug``.
VARIABLE = "TRACKLANE_LOG"


def start_logging(wanted: str | None = None) -> bool:
    """Messages of this package to the error stream, from warnings up or as ``wanted`` (else the variable) says.

    Where the program has set up logging already, its ways hold and nothing is done; tells whether it was.
    """
    own = logging.getLogger("tracklane")
    if own.handlers or logging.getLogger().handlers:
        return False
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(logging.Formatter("%(levelname)s %(message)s"))
    own.addHandler(handler)
    own.setLevel(logging.WARNING)
    for part in filter(None, (wanted if wanted is not None else os.environ.get(VARIABLE, "")).split(",")):
        name, _, level = part.strip().rpartition("=")
        number = logging.getLevelNamesMapping().get(level.upper())
        if number is None:
            own.warning("%s names no level of logging; left out", part)
        else:
            logging.getLogger(name or "tracklane").setLevel(number)
    return True
