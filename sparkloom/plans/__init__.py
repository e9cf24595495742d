"""From SQL text of the dialect to Spark SQL."""
