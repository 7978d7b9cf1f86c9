"""weir: a Spark-native analytics engine for labelled flow tables and corpora."""
