"""Event-time stream analytics and corpus processing on PySpark."""
