"""Document analytics on PySpark: corpora in, typed DataFrames out, every edit a column transform."""
