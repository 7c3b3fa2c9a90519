"""tideglass: retrieval, memory, graph and evaluation analytics as PySpark DataFrame operators."""
