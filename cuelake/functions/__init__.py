"""functions of the caption and usage engine."""
