"""Column expressions: text, citations and arithmetic that need no shuffle."""
