"""Streams of transactions: verdicts row by row, and transactions assembled from chunks."""
