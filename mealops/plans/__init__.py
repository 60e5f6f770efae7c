"""End-to-end table builds composed from the operators."""
