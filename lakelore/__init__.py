"""lakelore: a Spark-native retrieval and document-governance engine."""
