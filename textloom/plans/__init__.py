"""The query language and the registered queries."""
