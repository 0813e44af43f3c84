"""Training-data operators: language models, sketches, scans, token files."""
