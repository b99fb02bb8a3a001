"""Spark jobs that translate document collections: manifest, segments, batches, model answers, reassembled documents and a run report."""
