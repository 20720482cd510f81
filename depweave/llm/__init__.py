"""Training-data operators over the documents, pages and embeddings tables."""
