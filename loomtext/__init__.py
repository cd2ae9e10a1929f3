"""loomtext: tables and free text queried together, on Spark."""
