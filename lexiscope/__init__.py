"""Text-corpus analytics and article classification on PySpark DataFrames."""
