"""tessera: a Spark-first relational analytics engine."""
