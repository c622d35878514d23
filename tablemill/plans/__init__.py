"""Node and edge specs folded into DataFrames."""
