"""domquarry: query raw web pages, and clean text corpora, with PySpark."""
