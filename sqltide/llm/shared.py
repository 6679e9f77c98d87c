"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

from sqltide.sources.store import stored

__all__ = ["stored"]
