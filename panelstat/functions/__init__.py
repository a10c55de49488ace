"""Column functions: tokens, calendar and age, text normalisation, statistics."""
