"""The same row stages over streams."""
