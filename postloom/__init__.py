"""postloom: a PySpark-native engine for streams of short posts and corpus-scale text."""
