"""Root-cause analytics over monitoring tables and streams, as PySpark DataFrame operators."""
