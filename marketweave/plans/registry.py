"""All queries of the library, and their SQL."""

from __future__ import annotations

from marketweave.plans import checks, flows, market, news, recorded, series, sinks

QUERIES = {**series.QUERIES, **market.QUERIES, **news.QUERIES, **checks.QUERIES, **flows.QUERIES, **recorded.QUERIES, **sinks.QUERIES}
ORACLE_SQL = {**series.ORACLE_SQL, **market.ORACLE_SQL, **news.ORACLE_SQL, **checks.ORACLE_SQL, **flows.ORACLE_SQL, **recorded.ORACLE_SQL, **sinks.ORACLE_SQL}
