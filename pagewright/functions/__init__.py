"""Column-level functions: URLs, HTML, text and display formats."""
