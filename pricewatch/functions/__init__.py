"""Functions of the price and stock library."""
