"""Column helpers: calendar and number semantics, and the fixed business values."""
