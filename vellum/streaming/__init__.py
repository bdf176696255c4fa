"""Order-dependent folds and their Structured Streaming forms."""
