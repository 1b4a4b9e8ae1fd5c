"""leadloom: business-lead data work as PySpark DataFrames and streams."""
