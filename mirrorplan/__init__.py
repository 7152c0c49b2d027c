"""Media-library planning and training-data operators on PySpark DataFrames."""
