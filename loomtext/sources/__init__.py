"""sources of loomtext."""
