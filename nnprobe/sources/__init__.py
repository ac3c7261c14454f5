"""Sources and sinks: vector tables, synthetic vectors, reference buckets, result documents, measurement rows."""
