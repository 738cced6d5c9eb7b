"""Column functions: plain ``Column -> Column`` helpers."""
