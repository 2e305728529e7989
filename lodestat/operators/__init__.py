"""DataFrame operators of the core: temporal, ingestion, quality, claims, hierarchy, units, time."""
