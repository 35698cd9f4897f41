"""Training-data operators: text scoring, matching, extraction and encoding over large document tables."""
