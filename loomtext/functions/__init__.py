"""functions of loomtext."""
