"""Objects that a Python process keeps from task to task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What ``make()`` gave when this process first asked for ``key``.

    The objects are attributes of a module that exists in the process alone. Functions that are
    pickled by value name it and never carry what it holds, so a driver that has
    made an object of its own sends none of it with its tasks.
    """
    name = "lodestone_kept"
    held = vars(sys.modules.setdefault(name, types.ModuleType(name))).setdefault("objects", {})
    if key not in held:
        held[key] = make()
    return held[key]
