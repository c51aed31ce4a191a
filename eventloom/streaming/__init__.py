"""Detection rules on streams."""
