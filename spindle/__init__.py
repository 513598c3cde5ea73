"""spindle: a Spark-native engine for archival records, linkage and data stewardship."""
