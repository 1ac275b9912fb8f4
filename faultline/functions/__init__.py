"""Column functions: text normalisation and scalar rules."""
