"""The same rules over streams."""
