"""Analytics for evaluating models on source code and text, as PySpark DataFrame transformations."""
