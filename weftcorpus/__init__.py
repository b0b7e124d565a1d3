"""weftcorpus: a PySpark-native engine for building, auditing and accounting for text corpora."""
