"""Column expressions: text, numbers and dates with fixed null and rounding rules."""
