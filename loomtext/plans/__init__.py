"""plans of loomtext."""
