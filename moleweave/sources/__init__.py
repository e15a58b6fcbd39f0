"""Reading and writing molecule tables."""
