"""Images and palettes from files, and back to files."""
