"""Reading landing files and publishing tables."""
