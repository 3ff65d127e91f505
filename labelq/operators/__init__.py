"""Table-in, table-out operators: preparation, noise, detection, metrics."""
