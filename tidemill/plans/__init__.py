"""Named transformations, grouped by subject; each takes and returns DataFrames."""
