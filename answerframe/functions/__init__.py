"""Column expressions: text cleaning, tokens, readability formulas, stemming."""
