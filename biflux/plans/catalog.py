"""All registered queries: name -> (Spark callable, oracle SQL or None)."""

from biflux.plans import (
    compare_queries, match_queries, packet_queries, profile_queries, scenario_queries, source_queries, validation_queries)

CATALOG = {
    **compare_queries.QUERIES, **profile_queries.QUERIES, **packet_queries.QUERIES, **validation_queries.QUERIES, **scenario_queries.QUERIES,
    **match_queries.QUERIES, **source_queries.QUERIES,
}
