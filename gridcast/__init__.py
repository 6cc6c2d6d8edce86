"""Analytics over gridded, multi-run and ensemble forecast data on PySpark."""
