"""Market-bar analytics as Spark DataFrame transforms."""
