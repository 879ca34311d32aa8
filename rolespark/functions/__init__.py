"""Column functions: strings, dates, places, labels."""
