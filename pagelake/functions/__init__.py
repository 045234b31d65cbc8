"""Column-expression helpers: all native Spark functions, no Python UDFs."""
