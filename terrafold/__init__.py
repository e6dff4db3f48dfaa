"""Street-map analytics and data preparation as PySpark DataFrame operators."""
