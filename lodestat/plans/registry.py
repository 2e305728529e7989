"""All queries of the core and their SQL oracles."""

from __future__ import annotations

from lodestat.plans import claims, dealt, events, listings, observations, pipelines

QUERIES = {**observations.QUERIES, **claims.QUERIES, **events.QUERIES, **pipelines.QUERIES, **listings.QUERIES, **dealt.QUERIES}
SQL = {**observations.SQL, **claims.SQL, **events.SQL, **pipelines.SQL, **listings.SQL, **dealt.SQL}
