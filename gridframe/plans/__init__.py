"""Planning helpers: SQL over grid tables, and pruning of chunks."""
