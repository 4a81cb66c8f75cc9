"""portage: move tables and stored sources between databases as Spark jobs."""
