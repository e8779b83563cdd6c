"""The data work of each stage, as functions over DataFrames."""
