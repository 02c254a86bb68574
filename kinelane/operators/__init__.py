"""DataFrame -> DataFrame operators, partitioned by series (and lane)."""
