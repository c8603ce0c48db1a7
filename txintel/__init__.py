"""txintel: two-layer transaction traffic analytics as ordinary Spark DataFrame transforms."""
