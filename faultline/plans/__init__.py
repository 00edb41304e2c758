"""Views over the given tables and the registered queries, each with the same query as SQL."""
