"""Column functions and vectorised functions on text, layouts and models."""
