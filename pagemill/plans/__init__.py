"""Whole jobs composed of the operators, and the queries registered for checking them."""
