"""Column functions: text normalisation, tokens, and polymorphic JSON."""
