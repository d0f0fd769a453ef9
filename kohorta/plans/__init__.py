"""Plans over the benchmark tables: views, queries and their SQL."""
