"""A PySpark-native engine for T-SQL scripts: execution of their queries and analysis of script corpora."""
