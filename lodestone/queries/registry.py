"""All queries but those of the training-data subpackage."""

from __future__ import annotations

from . import data, flows, search, text

QUERIES = {**text.QUERIES, **search.QUERIES, **data.QUERIES, **flows.QUERIES}
ORACLES = {**text.ORACLES, **search.ORACLES, **data.ORACLES, **flows.ORACLES}
