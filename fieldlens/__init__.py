"""Analytics over object tracks as composable PySpark DataFrame operations."""
