"""Exception analytics on Spark: which changes go with breaks, and why."""
