"""fieldgrid package."""
