"""veilframe: a PySpark-native engine for privacy-preserving text, UI-tree and agent-trace analytics."""
