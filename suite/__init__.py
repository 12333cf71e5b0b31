"""Check queries: each library operator on the given tables, beside plain SQL."""
