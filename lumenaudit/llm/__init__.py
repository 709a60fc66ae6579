"""Training-data operators: each is a DataFrame job; nothing else in the package imports them."""
