"""Training-data pipeline operators (deduplication, sharding, filters, packing, scoring) on Spark.

Nothing else in the library imports this subpackage.
"""
