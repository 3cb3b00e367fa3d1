"""Training-data operators: each module holds one operator, `queries` binds them to the tables."""
