"""Table-level operators: joins, aggregations and windows."""
