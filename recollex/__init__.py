"""recollex: a PySpark-native engine for agent-memory analytics.

Documents, embeddings, typed memories, knowledge graphs, event logs and token
costs live in DataFrames; every operator is a function from DataFrames to a
lazy DataFrame.
"""

__version__ = "0.1.0"
