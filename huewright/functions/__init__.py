"""Column functions: colour spaces and palette text."""
