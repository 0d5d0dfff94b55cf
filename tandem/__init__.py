"""tandem: a Spark-native engine for comparing two document corpora article by article."""
