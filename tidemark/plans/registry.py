"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from tidemark.plans import market, news, problems, streams, surface

FLAGSHIP = "symbol_context"
QUERIES = {**problems.QUERIES, **market.QUERIES, **news.QUERIES, **streams.QUERIES, **surface.QUERIES}
ORACLES = {**problems.ORACLES, **market.ORACLES, **news.ORACLES, **streams.ORACLES, **surface.ORACLES}
