"""Table-structure operators: DataFrames in, DataFrames out, all keyed by table_id."""
