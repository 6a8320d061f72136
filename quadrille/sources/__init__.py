"""Sources of cells."""
