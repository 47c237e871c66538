"""Tools over streams."""
