"""Panel-data risk jobs as PySpark DataFrame transformations."""
