"""claimwright: a Spark-native engine for confidence-scored claims, entities and edges."""

__version__ = "0.1.0"
