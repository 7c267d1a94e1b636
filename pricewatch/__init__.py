"""Price and stock intelligence over Spark tables and streams."""
