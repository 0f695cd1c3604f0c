"""Column-level building blocks: only built-in Spark functions, no Python workers."""
