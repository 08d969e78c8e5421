"""Series of repeated measurements, and training text, as DataFrame jobs."""
