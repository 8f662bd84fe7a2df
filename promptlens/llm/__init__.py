"""Training-data pipeline operators (one module each); nothing else in the library imports them."""
