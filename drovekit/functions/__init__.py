"""Column builders over arrays and feature kinds."""
