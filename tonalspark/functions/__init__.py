"""Column functions: vectors, text, colours and emotions."""
