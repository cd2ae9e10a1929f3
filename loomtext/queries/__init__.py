"""queries of loomtext."""
