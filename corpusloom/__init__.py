"""corpusloom: a Spark-native engine for document corpora, retrieval and retrieval evaluation."""
