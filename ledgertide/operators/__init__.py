"""Reusable relational operators that stay balanced when one key holds most of the rows."""
