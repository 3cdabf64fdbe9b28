"""Text-pattern mining over a weighted context-pattern graph, on PySpark."""
