"""DataFrame operators of the cache workload."""
