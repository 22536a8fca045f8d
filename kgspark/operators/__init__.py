"""The operators of the algebra, lowered to DataFrames."""
