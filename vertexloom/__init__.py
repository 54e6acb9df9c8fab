"""vertexloom: a Spark-native analytics engine for body-centred cubic lattices."""

__version__ = "0.1.0"
