"""All queries of the package but those of the training-data operators."""

from zonalspark.plans import detail_queries, geometry_queries, ingest_queries, listing_queries, relational_queries, shape_queries, spatial_queries, stream_queries, upkeep_queries

MODULES = (spatial_queries, relational_queries, listing_queries, geometry_queries, upkeep_queries, ingest_queries, detail_queries, shape_queries, stream_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
