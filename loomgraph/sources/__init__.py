"""Reading a corpus of source files and writing the graph tables."""
