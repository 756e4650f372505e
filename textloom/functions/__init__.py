"""Analysis, scoring formulas and encodings, as columns."""
