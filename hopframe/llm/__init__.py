"""Training-data operators over tables of documents, pages and labels."""
