"""minekit: market-basket, text and tabular mining as plain PySpark DataFrame functions."""
