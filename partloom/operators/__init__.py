"""DataFrame operators: each takes and returns DataFrames, none collects rows to the driver."""
