"""Session helpers shared by all operators."""
