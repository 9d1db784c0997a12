"""User-level entry functions composed of operators."""
