"""Training-data operators: filtering, de-duplication, mixing and formatting of text corpora."""
