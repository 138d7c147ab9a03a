"""Episode analytics over very large event logs, written as PySpark DataFrame operators."""
