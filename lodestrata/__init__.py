"""A document-evidence engine on PySpark DataFrames."""
