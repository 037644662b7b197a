"""Column expressions: parsing, recoding, binning, calendar parts, display text."""
