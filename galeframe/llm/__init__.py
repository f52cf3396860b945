"""Training-data operators over a table of documents. Nothing outside this package imports it."""
