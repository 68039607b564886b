"""Column-expression builders (pure ``pyspark.sql.Column`` helpers, JVM-side)."""
