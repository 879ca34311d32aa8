"""Entry points for landed files as streams."""
