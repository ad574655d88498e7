"""corpusloom: a Spark-native text-corpus curation engine."""
